"""The tables that the queries run on, derived from the driver's; each select list is the same text in Spark and DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vitrine.sources.readers import table

#: name: (select list, table)
VIEWS = {
    "v_mention": (
        """p_partkey as mention_id, p_partkey % 50 as catalog_id, (p_partkey % 50) % 10 as supplier_id,
  1 + cast(floor(p_partkey / 50.0) as bigint) % 20 as page_number,
  (p_partkey % 50) * 100 + 1 + cast(floor(p_partkey / 50.0) as bigint) % 20 as page_id,
  p_name as name_pt, lower(p_type) || '_' || split_part(p_name, ' ', 2) as function_group,
  p_brand as category, split_part(p_name, ' ', 1) as color, split_part(p_name, ' ', 2) as thing, (p_size % 7 = 0) as is_kit,
  p_partkey % 500 as vec_id, cast((p_partkey * 37) % 101 as double) / 100.0 as synthetic_similarity, p_size as size,
  'EL-' || cast(1000 + p_partkey as varchar(20)) || ' R$ ' || cast(p_size as varchar(20)) || ',9 PCS/CX 60' as layout_text""",
        "part",
    ),
    "v_box": (
        """o_orderkey as box_id, o_orderkey % 200 as page_id, cast((o_custkey * 13) % 900 as double) as x,
  cast((o_orderkey * 29) % 1200 as double) as y, cast(60 + cast(floor(o_totalprice) as bigint) % 200 as double) as width,
  cast(60 + (o_orderkey * 7) % 180 as double) as height, cast((o_orderkey * 31) % 97 as double) / 97.0 as confidence""",
        "orders",
    ),
    "v_catalog": (
        """c_custkey as catalog_id, c_custkey % 40 as supplier_id, c_name || '.pdf' as file_name,
  case when c_nationkey % 5 = 0 then 'PROCESSING' when c_nationkey % 5 = 1 then 'FAILED' else 'READY' end as status""",
        "customer",
    ),
    "v_supplier": ("s_suppkey as supplier_id, s_name as supplier_name", "supplier"),
    "v_page": (
        """o_orderkey as page_id, o_custkey as catalog_id, cast(o_orderkey % 97 as int) as page_number, o_orderpriority as model,
  case when o_orderstatus = 'F' then 'HEURISTIC' when o_orderstatus = 'O' then 'GRID_LAYOUT' else 'VISION_CHEAP' end as decision,
  case when o_orderkey % 11 = 0 then 'timeout' end as error, cast(o_orderkey % 7 as bigint) as mentions,
  'https://x/storage/v1/object/public/pages/' || cast(o_custkey as varchar(20)) || '/p' || cast(o_orderkey % 50 as varchar(20)) || '.jpg' as image_url""",
        "orders",
    ),
    "v_candidate": (
        """l_orderkey * 10 + l_linenumber as candidate_id, l_orderkey as page_id, l_returnflag as flag,
  case when l_linenumber % 5 = 0 then null else l_discount * 10 end as quality_score, (l_linestatus = 'O') as is_searchable,
  cast(l_quantity * 20 as double) as width, cast(l_tax * 4000 + 100 as double) as height""",
        "lineitem",
    ),
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    columns, source = VIEWS[name]
    parts, depth, own = [], 0, ""
    for sign in columns:  # split at commas outside brackets and strings
        depth += (sign == "(") - (sign == ")")
        if sign == "," and not depth and own.count("'") % 2 == 0:
            parts.append(own)
            own = ""
        else:
            own += sign
    return table(spark, sf_dir, source).selectExpr(*parts, own)


def sql_view(name: str) -> str:
    columns, source = VIEWS[name]
    return f"{name} as (select {columns} from {source})"
