"""The queries of the llm operators and, where SQL can say the same, their SQL."""

from __future__ import annotations

from quillmark.llm import canonical, leaks, lookalike, near_dup, packing, pair_defects, private, scan_noise

QUERIES = {
    "p1_found": near_dup.p1_found,
    "p1_groups": near_dup.p1_groups,
    "p2_found": pair_defects.p2_found,
    "p3_found": lookalike.p3_found,
    "p3_normalised": lookalike.p3_normalised,
    "p4_found": canonical.p4_found,
    "p5_found": scan_noise.p5_found,
    "p5_repaired": scan_noise.p5_repaired,
    "p6_packed": packing.p6_packed,
    "p6_usage": packing.p6_usage,
    "p7_found": leaks.p7_found,
    "p7_items": leaks.p7_items,
    "p8_found": private.p8_found,
    "p8_replaced": private.p8_replaced,
}

#: White space as Python's split sees it.
_WS = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"

#: Words without marks, lower-cased.
_PLAIN = rf"list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^\p{{L}}\p{{N}}\p{{M}}\s]+', '', 'g'), '{_WS}'), lambda x: x <> '')"
#: Every shift at which a document and an item share enough words, then every stretch of the item that begins with a
#: shared word, holds half of it and differs in one word of ten at most.
_LEAKS = rf"""with d as (select doc_id, {_PLAIN} as ws from documents where doc_id is not null and text is not null), i as (select item_id, {_PLAIN} as ws from eval_item where item_id is not null and text is not null),
  dw as (select doc_id, unnest(ws) as w, generate_subscripts(ws, 1) as p from d), iw as (select item_id, unnest(ws) as w, generate_subscripts(ws, 1) as q from i),
  n as (select item_id, len(ws) as n from i), hit as (select doc_id, item_id, p - q as shift, q from dw join iw using (w)),
  cand as (select doc_id, item_id, shift, list(q order by q) as qs, any_value(n) as n from hit join n using (item_id) group by doc_id, item_id, shift having count(*) >= 0.44 * any_value(n)),
  leak as (select distinct doc_id, item_id from cand, lateral (select 1 from (select unnest(qs) as a) x, (select unnest(range(1, n + 1)) as b) y where b >= a and b - a + 1 >= 0.5 * n and b - a + 1 - len(list_filter(qs, lambda z: z >= a and z <= b)) <= 0.1 * (b - a + 1) limit 1))
"""

SQL: dict[str, str] = {
    # exact join on the rarest words of either side (two sets this alike share one of them), then the whole test
    "p1_found": rf"""with q as (select distinct id, stem from question where id is not null and stem is not null),
  w as (select id, stem, list_distinct(list_filter(list_transform(regexp_split_to_array(lower(stem), '{_WS}'), lambda x: trim(x, '.,;:?!()[]"''\')), lambda x: x <> '')) as ws from q),
  k as (select *, row_number() over () as n from w where len(ws) >= 12),
  t as (select n, id, len(ws) as size, unnest(ws) as wd from k), f as (select wd, count(*) as df from t group by wd),
  r as (select t.*, row_number() over (partition by n order by df, t.wd) as pos from t join f using (wd)),
  p as (select n, id, wd from r where pos <= size - ceil(0.75 * size) + 1),
  c as (select distinct a.n as a, b.n as b from p a join p b using (wd) where a.id < b.id),
  v as (select x.id as id_a, y.id as id_b, len(list_intersect(x.ws, y.ws)) as s, len(x.ws) + len(y.ws) as total from c join k x on x.n = c.a join k y on y.n = c.b)
  select distinct id_a, id_b from v where s >= 0.75 * (total - s)""",
    # characters that stand for others, as classes: forms, ligatures, invisible ones, blanks, hyphens, loose accents,
    # Cyrillic look-alikes, Greek ones next to Latin letters
    "p3_found": r"""select distinct id, field_name from (select id, unnest(['stem', 'explanation']) as field_name, unnest([stem, explanation]) as t from question where id is not null) where regexp_matches(t,
  '[\x{ff01}-\x{ff5e}\x{fb00}-\x{fb06}\x{ad}\x{200b}-\x{200f}\x{2060}-\x{2064}\x{feff}\x{fe00}-\x{fe0f}\x{a0}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}\x{2010}\x{2011}]|[A-Za-z\x{c0}-\x{24f}][\x{300}-\x{36f}]|[асеорхуѕіјһԁԛԝѵӏАВЕКМНОРСТХУЅІЈ]|[A-Za-z][οιΑΒΕΖΗΙΚΜΝΟΡΤΥΧ]|[οιΑΒΕΖΗΙΚΜΝΟΡΤΥΧ][A-Za-z]|[A-Za-z][A-Za-z][νκυχ]|[A-Za-z][νκυχ][A-Za-z]|[νκυχ][A-Za-z][A-Za-z]')""",
    "p7_found": _LEAKS + "select doc_id, item_id from leak",
    "p7_items": _LEAKS + "select item_id, origin, coalesce(n_docs, 0) as n_docs from eval_item left join (select item_id, count(*) as n_docs from leak group by 1) using (item_id)",
}
