"""DuckDB SQL for the queries over rows as they are written and shown."""

from __future__ import annotations

from vitrine.plans.oracle import _PROFILE_VECTOR
from vitrine.plans.views import sql_view

_DATED = "dated as (select *, date '2024-01-01' + (catalog_id * 37 % 700)::int as created_at from v_catalog)"
_CATALOGS = "catalogs as (select distinct catalog_id, case when catalog_id <> 49 then catalog_id % 10 end as supplier_id, 'catalog-' || catalog_id || '.pdf' as file_name from v_mention)"


def _with(sql: str, *ctes: str, recursive: bool = False) -> str:
    used = [sql_view(v) for v in ("v_mention", "v_page", "v_candidate", "v_catalog", "v_supplier") if v in sql or any(v in c for c in ctes)]
    return f"with {'recursive ' * recursive}" + ",\n".join([*used, *ctes]) + "\n" + sql


SQL = {
    "insert_pages": _with("select page_id::varchar as id, catalog_id::varchar as catalog_id, page_number, image_url, 1190 as width, (page_id % 2000)::int as height from v_page"),
    "insert_analyses": _with("""select page_id::varchar as id, catalog_id::varchar as catalog_id, page_number, null::varchar as provider, model, case when error is not null then '{"products":[]}' else '{"products":[' || array_to_string(list_transform(range(mentions), lambda i: '{}'), ',') || ']}' end as raw_json,
  case when error is not null then 0 else mentions end::int as products_count, error from v_page"""),
    "insert_mentions": _with("""select mention_id::varchar as id, catalog_id::varchar as catalog_id, page_id::varchar as page_id, page_number::int as page_number, name_pt, color as colors, is_kit, case when mention_id % 2 = 0 and is_kit then 1 else 0 end as n_kit, synthetic_similarity as confidence,
  concat_ws(chr(10), name_pt, category, 'função: ' || function_group, 'cores: ' || color, case when is_kit then 'kit contém: ' || thing end) as search_text,
  case when mention_id % 5 <> 0 and mention_id % 3 <> 0 then '1,' || (mention_id % 8) end as vector from v_mention"""),
    "insert_candidates": _with("""select candidate_id::varchar as id, catalog_id::varchar as catalog_id, page_id::varchar as page_id, 'crops/' || candidate_id || '.jpg' as crop_url, width::int as width, floor(height)::int as height, case when flag = 'A' then 'EMBEDDED_IMAGE' else 'PAGE_CROP' end as source_type,
  (candidate_id % 4 <> 0 and is_searchable) as is_searchable, round(quality_score::double, 6) as quality_score, coalesce(candidate_id % 4 <> 0 and is_searchable and quality_score >= 0.6, false) as embed
from (select candidate_id, c.page_id, max(quality_score) as quality_score, bool_or(is_searchable) as is_searchable, max(width) as width, max(height) as height, max(flag) as flag from v_candidate c group by all) join v_page p using (page_id)"""),
    "vector_writeback": _with("""select mention_id, case when mention_id % 3 = 1 then mention_id::double when mention_id % 2 = 0 then 9.0::double end as first, case when mention_id % 3 = 1 or mention_id % 2 = 0 then 1 end::int as n from v_mention"""),
    "reembed_counts": _with("select count(*) as ok, 0::bigint as failed, count(*) as fresh from v_mention"),
    "upload_blobs": _with("select 's/' || supplier_id || '.txt' as path, 'https://x/storage/v1/object/public/s/' || supplier_id || '.txt' as url, null::varchar as error, supplier_name as content from v_supplier"),
    "crop_search": _with(
        """select vec_id as crop_id, url as crop_url, 'o' || vec_id || '.jpg' as original_url, catalog_id, round(similarity, 6) as similarity, 'catalog-' || catalog_id || '.pdf' as catalog_file_name, 'S' || (catalog_id % 10) as supplier_name, 'l' || label as detected_label, 'g' as function_group,
  0.5::double as confidence, round((vec_id % 10) / 10.0::double, 6) as quality_score, case when vec_id % 2 = 0 then 'n' end as product_name, null::varchar as product_name_pt, 'c' as category, null::varchar as model, null::varchar as description_pt, 'HEURISTIC' as source_detector,
  case when vec_id % 2 = 0 then 'n' else 'l' || label end as shown from folded where keep order by place limit 20""",
        _CATALOGS,
        f"""crops as (select vec_id, label, vec_id % 50 as catalog_id, (vec_id % 50) || '/c' || (vec_id // 100) || '.jpg' as url, vec_id % 4 = 0 as embedded, list_cosine_similarity(embedding::double[], q.q) as similarity
  from embeddings, {_PROFILE_VECTOR} q where vec_id % 3 <> 0 and (vec_id % 10) / 10.0 >= 0.5 and vec_id % 50 in (select catalog_id from catalogs where supplier_id < 9))""",
        "tops as (select * from (select *, row_number() over (order by embedded, similarity desc, vec_id) as place from crops) where place <= 100)",
        "seq as (select *, row_number() over (partition by catalog_id order by place) as k from tops)",
        """folded as (
  select distinct catalog_id, 0::bigint as k, 0::bigint as place, 0::bigint as vec_id, 0::bigint as label, ''::varchar as url, 0.0::double as similarity, false as keep, []::struct(u varchar, s double)[] as kept from seq
  union all
  select s.catalog_id, s.k, s.place, s.vec_id, s.label, s.url, s.similarity, len(list_filter(f.kept, lambda p: p.u = s.url or abs(p.s - s.similarity) < 1 - 0.97::double)) = 0,
    case when len(list_filter(f.kept, lambda p: p.u = s.url or abs(p.s - s.similarity) < 1 - 0.97::double)) = 0 then list_append(f.kept, struct_pack(u := s.url, s := s.similarity)) else f.kept end
  from folded f join seq s on s.catalog_id = f.catalog_id and s.k = f.k + 1
)""",
        recursive=True,
    ),
    "page_search_rows": _with(
        f"""select mention_id, t.catalog_id, page_id, page_number, name_pt, category, function_group, null::varchar as commercial_use, color as colors, '' as visual_attributes, '' as technical_attributes, is_kit, case when is_kit then thing else '' end as kit_contains, '' as not_confuse_with, null::varchar as description_pt,
  'https://x/pages/' || page_id || '.jpg' as page_image_url, file_name as catalog_file_name, c.supplier_id, s.supplier_name, round(similarity, 6) as similarity
from (select m.*, list_cosine_similarity(e.embedding::double[], q.q) as similarity from v_mention m join embeddings e using (vec_id), {_PROFILE_VECTOR} q where m.catalog_id <> 49 order by similarity desc, mention_id limit 200) t
join catalogs c on c.catalog_id = t.catalog_id join v_supplier s on s.supplier_id = c.supplier_id""",
        _CATALOGS,
    ),
    "supplier_pages": _with(
        """select supplier_id, supplier_name, count(catalog_id) as n, coalesce(bool_or(status = 'PROCESSING'), false) as processing,
  coalesce(string_agg(catalog_id || ' ' || status || ' ' || strftime(created_at, '%d/%m/%Y'), '|' order by created_at desc, catalog_id), '') as rows from v_supplier left join dated using (supplier_id) group by supplier_id, supplier_name""",
        _DATED,
    ),
    "suppliers_by_name": _with("""select supplier_id, supplier_name, count(c.catalog_id) as catalogs, coalesce(bool_or(c.status = 'PROCESSING'), false) as processing
from v_supplier s left join v_catalog c using (supplier_id) group by supplier_id, supplier_name order by supplier_name, supplier_id limit 25 offset 25"""),
    "catalog_cards": _with("select catalog_id, strftime(created_at, '%d/%m/%Y') as day, case catalog_id % 3 when 0 then (catalog_id % 7)::varchar when 1 then (catalog_id % 5)::varchar else '—' end as shown from dated", _DATED),
    "boxes_json": """select event_id, event_id % 6 in (2, 4, 5) as failed, case event_id % 6 when 0 then 7 when 1 then 2 when 3 then 1 end::int as page_number, case event_id % 6 when 0 then 2 when 1 then 1 else 0 end as n,
  case event_id % 6 when 0 then 5.0 when 1 then 6.0 end::double as width, case when event_id % 6 <= 1 then round(least(1.0, greatest(0.0, value)), 6) end as confidence from events""",
    "catalog_screen": _with("""select c.catalog_id, supplier_name, coalesce(np, 0) as n_pages, coalesce(nc, 0) as n_candidates, coalesce(nm, 0) as n_mentions, md5(coalesce(ms, '')) as mentions_md5
from v_catalog c join v_supplier using (supplier_id) left join (select catalog_id, count(*) as np from v_page group by 1) using (catalog_id)
left join (select catalog_id, count(*) as nc from (select distinct candidate_id, page_id from v_candidate) join v_page using (page_id) group by 1) using (catalog_id)
left join (select catalog_id, count(*) as nm, string_agg(mention_id::varchar, ',' order by page_number, case when mention_id % 6 <> 0 then synthetic_similarity end desc nulls first, mention_id) as ms from v_mention group by 1) using (catalog_id)"""),
    "mention_positions": _with("""select page_id, (i - 1)::int as pos, 'p' || i as name_pt, 't' || i as search_text, case when i <= 4 and i % 3 <> 0 then (i % 3)::double end as second
from (select page_id, unnest(range(1, mentions + 1)) as i from v_page where error is null)"""),
    "shown_texts": _with("""select mention_id, case when mention_id % 4 <= 1 then ' ' else name_pt end as sent,
  'in=' || case when a is null then '?' else a::varchar end || ' out=' || case when b is null then '?' else b::varchar end || ' total=' || coalesce((a + b)::varchar, '?') as usage,
  '[' || floor(mention_id % 9 / 2 + 0.5)::bigint || ',1 2×3]' as box, case mention_id % 3 when 0 then 'grid layout' when 1 then 'heurístico' else 'OTHER' end as detector,
  md5(concat_ws(chr(10) || chr(10), nullif(concat_ws(chr(10), case when mention_id % 2 = 0 then 'Fornecedor: ' || category end, case when mention_id % 3 = 0 then 'Arquivo: f.pdf' end), ''), 'Página ' || page_number || '. Responda somente com JSON.',
    case when mention_id % 5 <> 0 then 'Texto da página:' || chr(10) || substr(repeat(layout_text, 150), 1, 4000) end)) as prompt_md5, (mention_id % 7 * 2)::double as x, 2.0::double as height
from (select *, case when mention_id % 3 <> 0 then mention_id % 100 end as a, case when mention_id % 4 <> 0 then mention_id % 10 end as b from v_mention)"""),
    "aligned_vectors": "select vec_id, (vec_id * 10) || ',' || (vec_id * 10 + 1) || ',' || (vec_id * 10 + 2) as firsts from embeddings",
    "valid_requests": "select event_id, case when event_id % 4 = 0 then 'image/png' else 'image/jpeg' end as media_type, (event_id % 11 * 1048576)::bigint as n_bytes from events where event_id % 4 in (0, 2) and event_id % 5 <> 0 and event_id % 11 <= 8",
}
