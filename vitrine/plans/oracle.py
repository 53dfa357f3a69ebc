"""DuckDB SQL for the catalogue queries."""

from __future__ import annotations

from vitrine.plans.views import VIEWS, sql_view

_PROFILE_VECTOR = "(select embedding::double[] as q from embeddings where vec_id = 0)"
_NORM = "trim(regexp_replace(strip_accents(lower({0})), '[^a-z0-9]+', ' ', 'g'))"
_IOU = "(case when {w} > 0 and {h} > 0 then {w} * {h} / ({a}.width * {a}.height + {b}.width * {b}.height - {w} * {h}) else 0.0 end)"


def _overlap(axis: str, size: str, a: str, b: str) -> str:
    return f"greatest(0.0, least({a}.{axis} + {a}.{size}, {b}.{axis} + {b}.{size}) - greatest({a}.{axis}, {b}.{axis}))"


def _gap(axis: str, size: str, a: str, b: str) -> str:
    return f"greatest(0.0, greatest({a}.{axis}, {b}.{axis}) - least({a}.{axis} + {a}.{size}, {b}.{axis} + {b}.{size}))"


def _iou(a: str, b: str) -> str:
    return _IOU.format(a=a, b=b, w=_overlap("x", "width", a, b), h=_overlap("y", "height", a, b))


def _with(sql: str, *ctes: str, recursive: bool = False) -> str:
    """The query with the views it names in front."""
    used = [sql_view(v) for v in VIEWS if v in sql or any(v in c for c in ctes)]
    parts = [*used, *ctes]
    return (f"with {'recursive ' * recursive}" + ",\n".join(parts) + "\n" if parts else "") + sql


_KNN = f"select m.*, list_cosine_similarity(e.embedding::double[], q.q) as similarity from v_mention m join embeddings e using (vec_id), {_PROFILE_VECTOR} q order by similarity desc, mention_id limit 200"

_FACTS = f"""facts as (
  select *, {_NORM.format("function_group")} as g, {_NORM.format("name_pt || ' ' || function_group || ' ' || category")} as hay,
    string_split({_NORM.format("name_pt || ' ' || function_group")}, ' ') as offered, {_NORM.format("thing")} as kit,
    case when list_contains(string_split({_NORM.format("color")}, ' '), 'red') then 1 else 0 end as n_colors,
    least(1.0, greatest(0.0, similarity)) as s from candidates
), flags as (
  select *, contains(hay, 'small') as banned,
    is_kit and (kit in ('widget', 'gadget') and kit = 'gadget' or contains(kit, 'red widget') or contains(kit, 'economy widget') or contains(kit, 'gadget')) as in_kit,
    (g = 'economy widget' or contains(g, 'economy widget') or contains('economy widget', g)) as same, split_part(g, ' ', 1) = 'economy' as near,
    list_has_any(offered, ['widget', 'gadget']) as main from facts
), decided as (
  select *, case when banned then 'rejected' when in_kit then 'kit_contains' when same and main and n_colors >= 1 and s >= 0.6 then 'exact'
      when same and main then 'equivalent' when same or near then 'variant' when s < 0.35 then 'rejected' else 'related_but_not_match' end as match_type,
    case when banned then 'low' when in_kit then case when same or s > 0.78 then 'high' else 'medium' end
      when same and main and n_colors >= 1 and s >= 0.6 then case when s >= 0.7 then 'high' else 'medium' end
      when same and main then case when s >= 0.62 then 'medium' else 'low' end
      when same then case when s >= 0.7 and n_colors > 0 then 'medium' else 'low' end
      when near then case when s >= 0.7 then 'medium' else 'low' end else 'low' end as confidence,
    case when banned then 0.05 + 0.05 * s when in_kit then 0.7 + 0.2 * s when same and main and n_colors >= 1 and s >= 0.6 then 0.08 + 0.92 * s
      when same and main then 0.05 + 0.85 * s when same then 0.7 * s when near then 0.55 * s when s < 0.35 then 0.05 + 0.05 * s else 0.35 * s end as score,
    case when banned then 'Combina visualmente mas a função comercial está na lista mustNotMatch.' when in_kit then 'Kit contém red widget.'
      when same or near then concat_ws(', ', case when same then 'mesma função comercial' else 'função comercial próxima' end,
        case when main then 'produto principal compatível' end, case when n_colors > 0 then 'cor em comum (' || n_colors || ')' end)
      when s < 0.35 then 'Função comercial diferente e baixa similaridade textual.' else 'Função comercial diferente, mas algum sinal textual em comum.' end as reason
  from flags
)"""

_SPACE = "[ \\t\\n\\r\\f\\v]"
_SIGNAL = """body as (
  select *, layout_text || chr(10) || '• ' || name_pt || chr(10) || 'Caixa de Som ' || size || case when is_kit then ' UNID. CX R$ 7 R$ 8,50' else '' end as t from v_mention
)"""
_CODES = "list_distinct(list_transform(regexp_extract_all({0}, '\\b[A-Z]{{1,4}}[-\\s]?\\d{{2,5}}(?:-[A-Z0-9]{{1,5}})?\\b'), lambda c: upper(regexp_replace(c, '\\s+', '', 'g'))))"
_COUNT = "len(regexp_extract_all({0}, '{1}'))"
_PRICE, _PIECES, _UNITS = "R\\$\\s?\\d{1,4}(?:[.,]\\d{1,3})?", "(?i)PCS\\s*/\\s*CX", "(?i)UNID\\.?\\s*CX"
_LABELS = """len(list_filter(string_split({0}, chr(10)), lambda r: regexp_matches(r, '^\\s*(.{{2,40}}?)\\s+\\d{{1,3}}\\s*$')
      and not regexp_matches(regexp_extract(r, '^\\s*(.{{2,40}}?)\\s+\\d{{1,3}}\\s*$', 1), '(?i)R\\$|PCS\\s*/\\s*CX|UNID')
      and regexp_matches(regexp_extract(r, '^\\s*(.{{2,40}}?)\\s+\\d{{1,3}}\\s*$', 1), '[A-Za-zÀ-ÿ]')))"""

_DENSITY = """counts as (select page_id, y::int // 10 as i, count(*) as n from v_box group by all
), density as (
  select p.page_id, i.i, coalesce(n, 0) / 4.0 as density
  from (select distinct page_id from v_box) p, (select unnest(range(120)) as i) i left join counts c on c.page_id = p.page_id and c.i = i.i
)"""


def _runs(threshold: str) -> str:
    return f"""runs as (
  select page_id, min(i) as s, max(i) as e from (select *, i - row_number() over (partition by page_id order by i) as k from density where density < {threshold}) group by page_id, k
)"""


_REGIONS = """edges as (select page_id, s, e from gaps union all select distinct page_id, -1, -1 from density union all select distinct page_id, 120, 120 from density
), regions as (
  select * from (select page_id, e + 1 as a, lead(s) over (partition by page_id order by s, e) - 1 as b from edges) where b >= a
)"""


def _suppression(order: str, test: str, flag: bool, valid: str = "") -> str:
    """Greedy suppression in the order, page by page: at each step one box of every page meets those kept so far."""
    hit = f"len(list_filter(k.kept, lambda p: {_iou('p', 'b')} {test})) > 0"
    kept = "list_append(k.kept, struct_pack(x := b.x, y := b.y, width := b.width, height := b.height))"
    grown = kept if flag else f"case when {hit} then k.kept else {kept} end"
    return f"""ranked as (select *{valid}, row_number() over (partition by page_id order by {order}) as place from v_box
), folded as (
  select page_id, 0::bigint as place, 0::bigint as box_id, false as duplicate, []::struct(x double, y double, width double, height double)[] as kept from (select distinct page_id from v_box)
  union all
  select b.page_id, b.place, b.box_id, {hit}, {grown} from folded k join ranked b on b.page_id = k.page_id and b.place = k.place + 1
)"""


_GATE = "case when page_id % 5 = 0 then 'cover' when page_id % 5 = 1 then 'partial_grid' else 'category_grid' end"
_CANDIDATE_ROWS = """own as (
  select candidate_id, c.page_id, max(quality_score) as quality_score, bool_or(is_searchable) as is_searchable from v_candidate c group by all
), cand as (select own.*, p.catalog_id from own join v_page p using (page_id))"""

_LAYOUT = """items as (
  select mention_id // 12 as page_id, mention_id % 12 as k, k % 3 + 1 as c, k // 3 + 1 as r, 40 + k % 3 * 180 + mention_id % 7 as x, 60 + k // 3 * 190 + mention_id % 5 as y, layout_text
  from v_mention
)"""
_LINES = """cols as (
  select page_id, c, coalesce((m + lag(m) over w) / 2, lo) as x1, coalesce((m + lead(m) over w) / 2, hi) as x2
  from (select page_id, c, avg((x + 60) * 2.0) as m from items group by all) join (select page_id, min(x * 2.0) as lo, least(1190.0, max((x + 120) * 2.0)) as hi from items group by 1) using (page_id) window w as (partition by page_id order by c)
), rws as (
  select page_id, r, coalesce((m + lag(m) over w) / 2, lo) as y1, coalesce((m + lead(m) over w) / 2, hi) as y2
  from (select page_id, r, avg((y + 121) * 2.0) as m from items group by all) join (select page_id, min(y * 2.0) as lo, least(1684.0, max((y + 127) * 2.0)) as hi from items group by 1) using (page_id) window w as (partition by page_id order by r)
), tight as (
  select page_id, r, c, x1, y1, x2, y2, greatest(x * 2.0, x1) as a, greatest(y * 2.0, y1) as b, least((x + 120) * 2.0, x2) as d, least((y + 127) * 2.0, y2) as e
  from items join cols using (page_id, c) join rws using (page_id, r)
)"""

SQL = {
    "legacy_dedupe_top20": _with(
        "select place::int as place, crop_id, catalog_id, round(similarity, 6) as similarity from folded where keep order by place limit 20",
        f"""crops as (select vec_id as crop_id, label as catalog_id, label || '/c' || (vec_id // 2) || '.jpg' as url, vec_id % 4 = 0 as embedded, list_cosine_similarity(embedding::double[], q.q) as similarity
  from embeddings, {_PROFILE_VECTOR} q where vec_id % 3 <> 0 and (vec_id % 10) / 10.0 >= 0.5)""",
        "tops as (select * from (select *, row_number() over (order by embedded, similarity desc, crop_id) as place from crops) where place <= 100)",
        "seq as (select *, row_number() over (partition by catalog_id order by place) as k from tops)",
        """folded as (
  select distinct catalog_id, 0::bigint as k, 0::bigint as place, 0::bigint as crop_id, 0.0::double as similarity, false as keep, []::struct(u varchar, s double)[] as kept from seq
  union all
  select s.catalog_id, s.k, s.place, s.crop_id, s.similarity, len(list_filter(f.kept, lambda p: p.u = s.url or abs(p.s - s.similarity) < 1 - 0.97::double)) = 0,
    case when len(list_filter(f.kept, lambda p: p.u = s.url or abs(p.s - s.similarity) < 1 - 0.97::double)) = 0 then list_append(f.kept, struct_pack(u := s.url, s := s.similarity)) else f.kept end
  from folded f join seq s on s.catalog_id = f.catalog_id and s.k = f.k + 1
)""",
        recursive=True,
    ),
    "grid_detector": _with("""select page_id, r::int as r, c::int as c, round(greatest(x1, a - 0.04 * (d - a)), 6) as x, round(greatest(y1, b - 0.04 * (e - b)), 6) as y,
  round(least(x2, d + 0.04 * (d - a)) - greatest(x1, a - 0.04 * (d - a)), 6) as width, round(least(y2, e + 0.04 * (e - b)) - greatest(y1, b - 0.04 * (e - b)), 6) as height from tight""", _LAYOUT, _LINES),
    "card_detector": _with("""select page_id, (2 * k)::int as card_id, round(x1, 6) as x, round(y1, 6) as y, round(least(1190.0::double, x * 2 + 247.2::double) - x1, 6) as width, round(least(1684.0::double, y * 2 + 261.62::double) - y1, 6) as height, layout_text as text
from (select *, greatest(0.0::double, x * 2 - 7.2::double) as x1, greatest(0.0::double, y * 2 - 7.62::double) as y1 from items)""", _LAYOUT),
    "composite_split": _with("""select page_id, case when c = 1 then 0.0 else round(mx, 6) end as x, case when r = 1 then 0.0 else round(my, 6) end as y,
  round(case when c = 1 then mx else 700 - mx end, 6) as width, round(case when r = 1 then my else 900 - my end, 6) as height from (
  select page_id, (avg((x + 60) * 2.0) filter (c = 1) + avg((x + 60) * 2.0) filter (c = 2)) / 2 as mx, (avg((y + 121) * 2.0) filter (r = 1) + avg((y + 121) * 2.0) filter (r = 2)) / 2 as my
  from items where c <= 2 and r <= 2 group by page_id), (select unnest([1, 2]) as c), (select unnest([1, 2]) as r)""", _LAYOUT),
    "crop_texts": _with("select page_id, (r * 100 + c)::bigint as box_id, layout_text as box_text, true as valid, null::varchar as reason, 0.94::double as score from items", _LAYOUT),
    "page_search": _with(
        f"""select page_id, mention_id, catalog_id, page_number, s.supplier_name, match_type, confidence, round(score, 6) as score, n_others, others from (
  select *, row_number() over (order by score desc, similarity desc, mention_id) as top from (
    select *, row_number() over (partition by page_id order by score desc, similarity desc, mention_id) as place,
      least(4, count(*) over (partition by page_id) - 1)::int as n_others from decided where match_type <> 'rejected') p
  left join (select page_id as pid, string_agg(mention_id::varchar, ',' order by place) as others from (
    select page_id, mention_id, row_number() over (partition by page_id order by score desc, similarity desc, mention_id) as place from decided where match_type <> 'rejected')
    where place between 2 and 5 group by page_id) o on o.pid = p.page_id where place = 1) r
join v_supplier s on s.supplier_id = r.catalog_id % 10 where top <= 30""".replace("n_others, others from (", "n_others, coalesce(others, '') as others from ("),
        f"candidates as ({_KNN})",
        _FACTS,
    ),
    "knn_topk": f"select vec_id, label, round(list_cosine_similarity(embedding::double[], q.q), 6) as similarity from embeddings, {_PROFILE_VECTOR} q order by list_cosine_similarity(embedding::double[], q.q) desc, vec_id limit 20",
    "knn_top200_join": _with("select mention_id, page_id, supplier_name, round(similarity, 6) as similarity from candidates join v_supplier using (supplier_id)", f"candidates as ({_KNN})"),
    "vector_normalize": """select vec_id, round(v[1] / n, 6) as first, round(sqrt(list_sum(list_transform(v, lambda x: (x / n) * (x / n)))), 6) as norm, 16 as head,
  len(list_filter(v, lambda x: x <> 0)) > 0 as nonzero from (select *, sqrt(list_sum(list_transform(v, lambda x: x * x))) as n from (select vec_id, list_transform(embedding, lambda x: x::double * 3) as v from embeddings))""",
    "vector_literal": "select vec_id, '[' || array_to_string(list_transform(embedding, lambda x: floor(x * 1000)::int), ',') || ']' as literal from embeddings",
    "rerank_scores": _with("select mention_id, match_type, confidence, round(score, 6) as score, reason from decided", "candidates as (select *, synthetic_similarity as similarity from v_mention)", _FACTS),
    "normalize_tokens": f"""select doc_id, md5(n) as norm_md5, len(list_filter(string_split(n, ' '), lambda t: t <> ''))::int as n_tokens,
  len(list_distinct(list_filter(string_split(n, ' '), lambda t: t <> '')))::int as n_distinct from (select doc_id, {_NORM.format("text")} as n from documents)""",
    "search_text": _with("""select mention_id, concat_ws(chr(10), name_pt, category, 'função: ' || function_group, 'cores: ' || color, case when is_kit then 'kit contém: ' || thing end) as search_text,
  concat_ws(chr(10), name_pt, 'função: ' || function_group, category, 'cores: ' || color, 'sinônimos: ' || thing, 'Não confundir com: ' || color) as query_text from v_mention"""),
    "product_signals": _with(
        f"""select *, greatest(prices, pieces, units, n_codes) as products, (prices >= 2 or pieces >= 2 or units >= 2 or n_codes >= 3) as multi from (
  select mention_id, array_to_string(list_sort({_CODES.format("t")}), ',') as codes, {_COUNT.format("t", _PRICE)}::int as prices, {_COUNT.format("t", _PIECES)}::int as pieces,
    {_COUNT.format("t", _UNITS)}::int as units, len(list_filter(string_split(t, chr(10)), lambda r: regexp_matches(r, '^\\s*(?:[•▪◦‣·\\-–]|\\d+[.)])\\s+\\S')))::int as bullets,
    {_LABELS.format("t")}::int as n_labels, len({_CODES.format("t")})::int as n_codes from body)""".replace("select *, greatest", "select * exclude (n_codes), greatest"),
        _SIGNAL,
    ),
    "page_types": _with(
        f"""select page_id, products, case when page_id % 17 = 0 then 'unknown' when (n_labels >= 5 or regexp_matches(t, '(?i)\\b(sum[aá]rio|[ií]ndice|index|conte[uú]do)\\b')) and products <= 2 then 'summary'
  when products >= 6 then 'category_grid' when products >= 2 then 'partial_grid' when products = 1 then 'single_product'
  when fraction >= 0.35 or (regexp_matches(t, '(?i)\\b(cat[aá]logo|novidades|produtos|cole[cç][aã]o|institucional)\\b') and images <= 2) then 'cover'
  when images >= 3 then 'unknown' else 'non_product' end as page_type
from (select *, greatest({_COUNT.format("t", _PRICE)}, {_COUNT.format("t", _PIECES)}, {_COUNT.format("t", _UNITS)}, len({_CODES.format("t")}))::int as products, {_LABELS.format("t")} as n_labels from (
  select page_id, string_agg(said, chr(10) order by said collate binary) as t, count(*) as images, max(size) / 100.0 as fraction from (
    select *, case when page_id % 5 = 0 then name_pt when page_id % 5 = 1 and mention_id % 2 = 0 then 'CATÁLOGO ' || thing else layout_text end as said
    from v_mention) group by page_id))""".replace(" collate binary", "")
    ),
    "cluster_1d": _with("""select page_id, cluster::bigint as cluster, round(center, 6) as center, n,
  round(coalesce((center + lag(center) over w) / 2, 0.0), 6) as lo, round(coalesce((center + lead(center) over w) / 2, 1200.0), 6) as hi from (
  select page_id, cluster, avg(cx) as center, count(*) as n from (
    select *, sum(b) over (partition by page_id order by cx) as cluster from (
      select *, case when cx - lag(cx) over (partition by page_id order by cx) > 20 then 1 else 0 end as b from (select page_id, x + width / 2 as cx from v_box))) group by page_id, cluster)
window w as (partition by page_id order by center)"""),
    "gap_regions": _with("select page_id, 'gap' as kind, s::int as first, e::int as last from gaps union all select page_id, 'region', a::int, b::int from regions", _DENSITY, _runs("0.04"), "gaps as (select * from runs where e - s + 1 >= 3)", _REGIONS),
    "walk_to_gap": _with("""select page_id, coalesce(max(case when i <= 60 and density < 0.04 then i end) + 1, 0)::int as lo,
  coalesce(min(case when i >= 60 and density < 0.04 then i end) - 1, 119)::int as hi from density group by page_id""", _DENSITY),
    "content_bands": _with("""select d.page_id, coalesce(max(n), 0)::bigint as bands from (select distinct page_id from density) d left join (
  select page_id, count(*) as n from (select r.page_id, a, b, avg(density) as mean from regions r join density d on d.page_id = r.page_id and i between a and b group by all)
  where b - a + 1 >= 8 and mean >= 0.06 group by page_id) x using (page_id) group by d.page_id""", _DENSITY, _runs("0.02"), "gaps as (select * from runs where e - s + 1 >= 4)", _REGIONS),
    "point_in_cell": _with("""select page_id, box_id, cell from (select page_id, box_id, x + width / 2 as cx, y + height / 2 as cy from v_box), (select unnest(range(9)) as cell)
where cx between cell % 3 * 350.0 and cell % 3 * 350.0 + 350 and cy between cell // 3 * 450.0 and cell // 3 * 450.0 + 450"""),
    "nearest_anchor": _with(f"""select page_id, box_id, anchor_id, round(d, 6) as distance from (
  select t.page_id, t.box_id, a.box_id as anchor_id, {_gap("x", "width", "t", "a")} as dx, {_gap("y", "height", "t", "a")} as dy,
    {_overlap("x", "width", "t", "a")} as ox, {_overlap("y", "height", "t", "a")} as oy, dx + dy as d, row_number() over (partition by t.page_id, t.box_id order by dx + dy, a.box_id) as place
  from v_box t join v_box a on a.page_id = t.page_id and (a.box_id // 200) % 5 = 0 where (t.box_id // 200) % 5 <> 0 and t.width <= 550
    and (({_gap("y", "height", "t", "a")} <= 0.05 * 1400.0 and {_overlap("x", "width", "t", "a")} >= 0.4 * least(t.width, a.width))
      or ({_gap("x", "width", "t", "a")} <= 0.04 * 1000.0 and {_overlap("y", "height", "t", "a")} >= 0.4 * least(t.height, a.height)))) where place = 1"""),
    "touching_pairs": _with(f"""select a.page_id, a.box_id as a, b.box_id as b from v_box a join v_box b on a.page_id = b.page_id and a.box_id < b.box_id
where (({_gap("x", "width", "a", "b")} <= 0.015 * 1000.0 and {_gap("y", "height", "a", "b")} <= 0.015 * 1400.0) or {_iou("a", "b")} > 0.2)"""),
    "connected_images": _with(
        "select n.page_id, n.box_id, coalesce(min(reach), n.box_id) as component from nodes n left join r on r.node = n.box_id group by n.page_id, n.box_id",
        "nodes as (select * from v_box)",
        f"""links as (select a.box_id as a, b.box_id as b from nodes a join nodes b on a.page_id = b.page_id and a.box_id <> b.box_id
  where ({_gap("x", "width", "a", "b")} <= 0.015 * 1000.0 and {_gap("y", "height", "a", "b")} <= 0.015 * 1400.0) or {_iou("a", "b")} > 0.2)""",
        "r as (select box_id as node, box_id as reach from nodes union select r.node, l.b from r join links l on l.a = r.reach)",
        recursive=True,
    ),
    "nms_flagged": _with("select page_id, box_id, duplicate from folded where place > 0", _suppression("(box_id % 9 <> 0) desc, confidence desc, box_id", ">= 0.65", True), recursive=True),
    "nms_refined": _with("select page_id, box_id from folded where place > 0 and not duplicate", _suppression("0.4 * confidence desc, box_id", ">= 0.55", False), recursive=True),
    "nms_cards": _with("select page_id, box_id from folded where place > 0 and not duplicate", _suppression("width * height desc, box_id", "> 0.6", False), recursive=True),
    "box_classes": _with("""select box_id, round(case when w > 0 and h > 0 then x1 end, 4) as x, round(case when w > 0 and h > 0 then y1 end, 4) as y, round(case when w > 0 and h > 0 then w end, 4) as width, round(case when w > 0 and h > 0 then h end, 4) as height,
  case when w <= 0 or h <= 0 then 'invalid_box' when w < 180 or h < 180 then 'too_small' when w * h / 1400000 > 0.85 then 'too_large'
    when (y1 + h) / 1400 < 0.1 or y1 / 1400 > 0.92 then 'header_footer' when w / h > 4.5 then 'horizontal_bar' when w / h < 0.22 then 'vertical_column' end as reason from (
  select box_id, greatest(0.0, least(999.0, px * sx)) as x1, greatest(0.0, least(1399.0, py * sy)) as y1, greatest(0.0, least(1000.0, (px + pw) * sx)) - x1 as w, greatest(0.0, least(1400.0, (py + ph) * sy)) - y1 as h from (
    select *, case when u then 1000.0 else 1.0 end as sx, case when u then 1400.0 else 1.0 end as sy from (
      select *, px <= 1 and py <= 1 and px + pw <= 1.01 and py + ph <= 1.01 as u from (select box_id, x - 40 as px, y * 1.2 - 60 as py, width * 3 as pw, height * 2 as ph from v_box))))"""),
    "page_caps": _with("""select page_id, box_id, place from (
  select *, row_number() over (partition by page_id order by (box_id % 3 = 0) desc, confidence desc, box_id) as place from (
    select *, sum((box_id % 3 = 0)::int) over (partition by page_id order by (box_id % 3 = 0) desc, confidence desc, box_id rows unbounded preceding) as n from v_box) where box_id % 3 <> 0 or n <= 12) where place <= 18"""),
    "supplier_counts": _with("""select supplier_id, supplier_name, count(c.catalog_id) as catalogs, coalesce(bool_or(c.status = 'PROCESSING'), false) as processing
from v_supplier s left join v_catalog c using (supplier_id) group by supplier_id, supplier_name"""),
    "home_counts": _with("""select (select count(*) from v_supplier) as suppliers, (select count(*) from v_catalog where status = 'READY') as ready_catalogs,
  (select count(*) from v_page) as pages, (select count(*) from v_candidate) as candidates"""),
    "catalog_detail": _with("""select c.catalog_id, supplier_name, coalesce(np, 0) as n_pages, md5(coalesce(ps, '')) as pages_md5, coalesce(nc, 0) as n_candidates, md5(coalesce(cs, '')) as candidates_md5
from v_catalog c join v_supplier using (supplier_id)
left join (select catalog_id, count(*) as np, string_agg(page_id::varchar, ',' order by page_number, page_id) as ps from v_page group by 1) using (catalog_id)
left join (select catalog_id, count(*) as nc, string_agg(candidate_id::varchar, ',' order by is_searchable desc, quality_score desc nulls first, candidate_id) as cs from cand group by 1) using (catalog_id)""", _CANDIDATE_ROWS),
    "status_rollup": _with("""select *, case when analyzed > 0 then 'READY' else 'FAILED' end as status from (select catalog_id, count(*) as pages, count(*) filter (error is null) as analyzed,
  count(*) filter (error is null and mentions = 0) as empty, coalesce(sum(mentions) filter (error is null), 0)::bigint as mentions, substr(min(error), 1, 500) as error from v_page group by catalog_id)"""),
    "decision_histogram": _with("""select catalog_id, 0::bigint as page_skip, count(*) filter (decision = 'GRID_LAYOUT') as grid_layout, 0::bigint as pdf_layout, count(*) filter (decision = 'HEURISTIC') as heuristic,
  count(*) filter (decision = 'VISION_CHEAP') as vision_cheap, 0::bigint as vision_premium, 0::bigint as vision_off, 0::bigint as budget_exceeded, 0::bigint as fallback,
  count(*) filter (decision = 'VISION_CHEAP') as vision_calls, coalesce(string_agg(distinct model, ',' order by model) filter (decision = 'VISION_CHEAP'), 'none') as models from v_page group by catalog_id"""),
    "mentions_by_page": _with("""select page_id, count(*) as n_mentions, coalesce(string_agg(name_pt, '|' order by place) filter (place <= 8), '') as shown from (
  select *, row_number() over (partition by page_id order by case when mention_id % 6 <> 0 then synthetic_similarity end desc nulls first, mention_id) as place from v_mention) group by page_id"""),
    "upsert_outcomes": _with("""select 'supplier' as kind, name, case when name = '' then 400 when name in (select supplier_name from v_supplier) then 409 else 201 end as outcome from (
  select distinct case when catalog_id % 10 = 0 then '' when catalog_id % 3 = 0 then 'Supplier#' || lpad((catalog_id % 300)::varchar, 9, '0') else file_name end as name from v_catalog)
union all select 'catalog', catalog_id::varchar, case when catalog_id % 4 = 1 then 400 when catalog_id % 150 not in (select supplier_id from v_supplier) then 404 else 201 end from v_catalog"""),
    "delete_cascade": _with("""select 'catalogs' as kind, count(*) as n from v_catalog where status <> 'FAILED' union all
select 'pages', count(*) from alive union all select 'detached', count(*) from cand where page_id not in (select page_id from alive)""", _CANDIDATE_ROWS, "alive as (select * from v_page where catalog_id not in (select catalog_id from v_catalog where status = 'FAILED'))"),
    "distinct_paths": _with("select distinct catalog_id::varchar || '/p' || (page_id % 50)::varchar || '.jpg' as path from v_page"),
    "reprocess": _with("""select catalog_id, count(*) as pages, sum(page_number)::bigint as numbers from (
  select catalog_id, page_number from v_page where catalog_id not in (select catalog_id from v_page where catalog_id % 20 = 3 and page_id % 2 = 0)
  union all select catalog_id, page_number + 1 from v_page where catalog_id % 20 = 3 and page_id % 2 = 0) group by catalog_id"""),
    "tolerant_json": "select event_id, case when event_id % 5 <= 2 then try_cast(json_extract_string(props, '$.k') as bigint) end as k from events",
    "json_array_coerce": """select event_id, event_id % 7 = 0 as failed, case when event_id % 7 = 0 then 0 else 1 end as n, case when event_id % 7 <> 0 then 'n' end as name,
  case when event_id % 7 <> 0 then case event_id % 4 when 0 then 'a|1|true|x' when 1 then 'a|b|c' else '' end end as colors, case when event_id % 7 <> 0 then true end as is_kit,
  case when event_id % 7 <> 0 then least(1.0, greatest(0.0, value)) end as confidence from events""",
    "display_labels": _with("""select catalog_id, case status when 'PROCESSING' then 'Processando' when 'READY' then 'Pronto' else 'Falhou' end as status,
  ['Carregador', 'Antena de TV', 'Suporte de TV', 'Liquidificador portátil', 'Cabo USB', 'Câmera', 'Fone de ouvido', 'Caixa de som', 'Ventilador', 'Ferro de passar', 'Chaleira', 'Aspirador', 'Desconhecido', 'x_y'][catalog_id % 14 + 1] as label,
  'pages/page-' || lpad((catalog_id % 1000)::varchar, 3, '0') || '.jpg' as path, floor((catalog_id % 200)::double / 200 * 100 + 0.5)::bigint as pct, case when catalog_id % 3 = 0 then 'image/png' else 'image/jpeg' end as media from v_catalog"""),
    "structural_gate": _with(f"""select page_id, not skip and n > 0 and not few as good, case when skip then 'non_product_page' when n = 0 then 'no_searchable' when few then 'below_expected_grid(' || n || '/' || expected || ')' else 'searchable=' || n end as reason,
  case when skip then 0 else n end as searchable from (select *, k = 'cover' as skip, k = 'category_grid' and expected >= 4 and n < ceil(expected * 0.6) as few from (
  select p.page_id, {_GATE} as k, (p.page_id % 9)::int as expected, coalesce(c.n, 0) as n from v_page p left join (select page_id as pid, count(*) filter (is_searchable) as n from v_candidate group by 1) c on c.pid = p.page_id))"""),
    "heuristic_gate": _with("""select page_id, reason is null as good, reason, n as searchable, round(case when n = 0 or n < least_n or giant is not null then 0 else avg end, 6) as average, least_n as expected_min from (
  select *, case when n = 0 then 'no_searchable' when n < least_n then 'below_expected' when giant is not null then giant when avg < 0.8 then 'avg_quality_low' when severe > n then 'too_many_severe_rejects' end as reason from (
    select page_id, coalesce(n, 0) as n, avg, giant, coalesce(severe, 0) as severe, case when coalesce(total, 0) = 0 then 0 when total <= 2 then 1 when total <= 4 then 3 when total <= 6 then 5 else 7 end::int as least_n
    from v_page left join (select page_id, count(*) as total, count(*) filter (is_searchable) as n, avg(quality_score) filter (is_searchable) as avg, count(*) filter (flag = 'R') as severe,
      min_by(g, candidate_id) filter (g is not null) as giant from (select *, case when is_searchable and width / height > 3.0 then 'horizontal_giant' when is_searchable and width / height < 0.33 and width / height > 0 then 'vertical_giant' end as g from own) group by page_id) using (page_id)))""", """own as (select candidate_id, page_id, max(width) as width, max(height) as height, max(coalesce(quality_score, 0.9) + 0.013) as quality_score, bool_or(is_searchable) as is_searchable, max(flag) as flag from v_candidate group by all)"""),
    "cascade_decisions": _with("""select page_id, catalog_id, case when b is not null then b when n > 20 then 'BUDGET_EXCEEDED' when page_id % 6 <> 0 then 'VISION_CHEAP' else 'FALLBACK' end as decision,
  case when b is null and n <= 20 then 1 else 0 end as vision_calls from (select *, sum((b is null)::int) over (partition by catalog_id order by page_id rows unbounded preceding) as n from (
  select page_id, catalog_id, case when page_id % 10 = 0 then 'PAGE_SKIP' when page_id % 4 = 1 then 'GRID_LAYOUT' when page_id % 4 = 2 then 'PDF_LAYOUT' when page_id % 7 = 0 then 'HEURISTIC' end as b from v_page))"""),
    "cascade_premium": _with(
        """select page_id, catalog_id, case when b is not null then b when calls = 0 then 'BUDGET_EXCEEDED' when calls = 2 then 'VISION_PREMIUM' when page_id % 6 <> 0 then 'VISION_CHEAP' else 'FALLBACK' end as decision, calls as vision_calls from folded where place > 0""",
        """ranked as (select page_id, catalog_id, case when page_id % 10 = 0 then 'PAGE_SKIP' when page_id % 4 = 1 then 'GRID_LAYOUT' when page_id % 4 = 2 then 'PDF_LAYOUT' when page_id % 7 = 0 then 'HEURISTIC' end as b,
  (page_id % 6 <> 0 and page_id % 3 = 0) as second, row_number() over (partition by catalog_id order by page_id) as place from v_page)""",
        """folded as (select catalog_id, 0::bigint as place, 0::bigint as page_id, null::varchar as b, 0 as calls, 20 as rest from (select distinct catalog_id from v_page) union all
  select r.catalog_id, r.place, r.page_id, r.b, (r.b is null and f.rest > 0)::int + (r.b is null and f.rest > 1 and r.second)::int,
    f.rest - (r.b is null and f.rest > 0)::int - (r.b is null and f.rest > 1 and r.second)::int from folded f join ranked r on r.catalog_id = f.catalog_id and r.place = f.place + 1)""",
        recursive=True,
    ),
    "raster_stats": _with("""select page_id, count(*) as total, count(*) filter (white) as white, count(*) filter (green and not white) as green, count(*) filter (orange and not white and not green) as orange,
  round(avg((dark <> coalesce(before, false))::int), 6) as text from (
  select *, r > 240 and g > 240 and b > 240 as white, g > 100 and g > r + 40 and g > b + 40 as green, r > 180 and g > 60 and g < r - 20 and b < 100 and r > b + 60 as orange,
    r + g + b < 420 as dark, lag(r + g + b < 420) over (partition by page_id, y order by x) as before from (
    select page_id, x, y, max(v) filter (c = 0) as r, max(v) filter (c = 1) as g, max(v) filter (c = 2) as b from (
      select page_id, i % 96 // 3 as x, i // 96 as y, i % 3 as c, (i % 96 * 7 + i // 96 * 5 + page_id * 11 + case when page_id % 2 = 0 then i // 300 * 40 else 0 end) % 256 as v
      from (select distinct page_id from v_box), (select unnest(range(2304)) as i)) group by all)) group by page_id"""),
    "stream_ingest": "select conv_id % 16 as part, role, count(*) as n, sum(length(text))::bigint as chars from conversations group by all",
}
