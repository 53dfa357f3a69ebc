"""DuckDB SQL for the queries over drawn rasters: scenes as tables of pixels, pages by what is drawn on them."""

from __future__ import annotations

from vitrine.plans.scenes import CROPS, SCALE
from vitrine.plans.views import sql_view

_PIXELS = """pages as (select distinct page_id from v_box
), placed as (
  select page_id, x, y, page_id % 7 as kind, (x >= 32)::int as c, case when y >= 33 then 2 when y >= 18 then 1 else 0 end as r
  from pages, (select unnest(range(60)) as x), (select unnest(range(48)) as y)
), inside as (
  select *, c <= page_id % 2 and r <= page_id % 3 and x - (4 + c * 28) between 0 and 21 + page_id % 5 and y - (3 + r * 15) between 0 and 9 + page_id % 4 as hit from placed
), colours as (
  select page_id, x, y,
    case when not hit or (kind = 3 and x % 2 = 1) then 255 when kind = 0 then 60 when kind = 1 then 20 when kind = 2 then 230 when kind = 3 then 20 when kind = 4 then 245 when kind = 5 then 200 else y * 5 end as red,
    case when not hit or (kind = 3 and x % 2 = 1) then 255 when kind = 0 then 90 when kind = 1 then 180 when kind = 2 then 120 when kind = 3 then 20 when kind = 4 then 245 when kind = 5 then 200 else 100 end as green,
    case when not hit or (kind = 3 and x % 2 = 1) then 255 when kind = 0 then 120 when kind = 1 then 40 when kind = 2 then 30 when kind = 3 then 20 when kind = 4 then 245 when kind = 5 then 200 else 50 end as blue from inside
), px as (
  select page_id, x, y, red > 240 and green > 240 and blue > 240 as white, green > 100 and green > red + 40 and green > blue + 40 as green,
    red > 180 and green > 60 and green < red - 20 and blue < 100 and red > blue + 60 as orange, red + green + blue < 420 as dark from colours
)"""


def _crops(*names: str) -> str:
    rows = ", ".join(f"('{n}', {', '.join(map(str, CROPS[n]))})" for n in names)
    return f"""crops as (select * from (values {rows}) as t(crop, x1, y1, x2, y2)
), cut as (
  select page_id, crop, x - x1 as x, y - y1 as y, x2 - x1 + 1 as w, y2 - y1 + 1 as h, y1, y2, white, green, orange, dark from px join crops on x between x1 and x2 and y between y1 and y2
)"""


#: Shares, mass in the middle and changes along rows of each crop.
_MEASURED = """measured as (
  select page_id, crop, any_value(w) as w, any_value(h) as h, any_value(y1) as y1, any_value(y2) as y2, avg(white::int) as white, avg((not white)::int) as filled,
    avg((green and not white)::int) as green, avg((orange and not white and not green)::int) as orange, avg((dark <> before)::int) as text,
    coalesce(count(*) filter (not white and x between greatest(0, cx - dx) and cx + dx and y between greatest(0, cy - dy) and cy + dy) / nullif(count(*) filter (not white), 0)::double, 0) as central
  from (select *, coalesce(lag(dark) over (partition by page_id, crop, y order by x), false) as before, floor((w - 1) / 2.0 + 0.5) as cx, floor((h - 1) / 2.0 + 0.5) as cy, floor(w * 0.25 + 0.5) as dx, floor(h * 0.25 + 0.5) as dy from cut)
  group by page_id, crop
)"""


def _aspect(low: str, high: str) -> str:
    return f"case when w / h::double between {low} and {high} then 1.0 else greatest(0.0, 1 - abs(ln(w / h::double)) * 0.5) end"


_BAR = "when w / h::double >= 2 and green > 0.3 then 'green_bar' when w / h::double >= 2 and orange > 0.3 then 'orange_bar'"
_WEAK = "when score < 0.6 and text > 0.1 then 'text_like' when score < 0.6 and central < 0.06 then 'no_central_object' when score < 0.6 then 'low_quality'"

#: Densities of the rows and columns of each crop.
_DENSITIES = """dense as (
  select page_id, crop, 'row' as axis, y as i, any_value(h) as n, avg((not white)::int) as d from cut group by page_id, crop, y
  union all select page_id, crop, 'column', x, any_value(w), avg((not white)::int) from cut group by page_id, crop, x
)"""
_CELLS = "cells as (select page_id, r, c from (select distinct page_id from v_box), (select unnest(range(3)) as r), (select unnest(range(2)) as c) where r <= page_id % 3 and c <= page_id % 2)"


def _with(sql: str, *ctes: str) -> str:
    return "with " + ",\n".join([sql_view("v_box"), *ctes]) + "\n" + sql


SQL = {
    "content_boxes": _with(
        """select a.page_id, a.x1, a.y1, a.x2, a.y2, round(central, 6) as central, round(greatest(0, rows), 6) as rows, round(greatest(0, columns), 6) as columns
from (select page_id, min(x) filter (not white) as x1, min(y) filter (not white) as y1, max(x) filter (not white) as x2, max(y) filter (not white) as y2 from px group by page_id) a
join measured using (page_id) join (select page_id, max(d) filter (axis = 'row') as rows, max(d) filter (axis = 'column') as columns from dense group by page_id) using (page_id)""",
        _PIXELS, _crops("whole"), _MEASURED, _DENSITIES,
    ),
    "crop_quality": _with(
        f"""select page_id, crop, round(score, 9) as score, reason, score >= 0.6 and reason is null as good from (
  select page_id, crop, case when early is null then score else 0 end as score, coalesce(early, case {_WEAK} end) as reason from (
    select *, case when white > 0.92 then 'mostly_white' when filled < 0.04 then 'insufficient_content' {_BAR} end as early,
      least(0.95, greatest(0, 0.35 * least(1, filled * 5) + 0.25 * least(1, central * 2.5) + 0.2 * (1 + {_aspect("0.5", "1.8")})
        - 0.15 * (greatest(0, text - 0.1) * 5 + 1.2 * (greatest(0, green - 0.22) + greatest(0, orange - 0.22))))) as score from measured))""",
        _PIXELS, _crops("whole", "left", "top", "cell", "cut"), _MEASURED,
    ),
    "card_quality": _with(
        f"""select page_id, crop, round(score, 9) as score, reason from (
  select page_id, crop, case when early = 'page_like_crop' then 0.25 when early is null then score else 0 end as score, coalesce(early, case {_WEAK} end) as reason from (
    select *, case when least(w, h) / {SCALE} < 220 then 'too_small' when w / h::double > 3.2 or (w / h::double > 2.5 and h / {SCALE} < 264) then 'too_horizontal' when w / h::double < 0.3 then 'too_vertical'
        when white > 0.9 then 'mostly_white' {_BAR} when filled < 0.05 then 'insufficient_content' when y2 / 48.0 < 0.1 or y1 / 48.0 > 0.92 then 'header_footer' when share > 0.75 then 'page_like_crop' end as early,
      least(0.95, greatest(0, 0.3 * least(1, filled * 5) + 0.2 * (least(1, central * 2.5) + {_aspect("0.6", "1.6")} + case when share < 0.02 then share * 30 when share > 0.55 then greatest(0.3, 1 - (share - 0.55) * 2) else 1 end) + 0.1
        - 0.15 * (greatest(0, text - 0.09) * 5 + 1.5 * (greatest(0, green - 0.18) + greatest(0, orange - 0.18))))) as score from (select *, w * h / 2880.0 as share from measured)))""",
        _PIXELS, _crops("whole", "top", "cell", "cut", "narrow", "low", "wide"), _MEASURED,
    ),
    "boundary_scores": _with(
        """select page_id, crop, round(least(1.0, greatest(0.0, 1 - least(1.0, greatest(0, top - 0.05) * 1.2 + greatest(0, bottom - 0.05) * 1.2 + greatest(0, lft - 0.05) * 1.2 + greatest(0, rgt - 0.05) * 1.2) - case when stacked then 0.5 else 0 end)), 9) as score,
  case when stacked or greatest(top, bottom) > 0.28 then 'bad_card_boundary' end as reason from (
  select page_id, crop, avg(d) filter (axis = 'row' and i < edge) as top, avg(d) filter (axis = 'row' and i >= n - edge) as bottom, avg(d) filter (axis = 'column' and i < edge) as lft, avg(d) filter (axis = 'column' and i >= n - edge) as rgt,
    coalesce(min(d) filter (axis = 'row' and i >= a and i < b), 1) < 0.02 and count(*) filter (axis = 'row' and i < a and d > 0.15) > 0 and count(*) filter (axis = 'row' and i >= b and d > 0.15) > 0 as stacked
  from (select *, greatest(2, floor(n * 0.04 + 0.5)) as edge, floor(n * 0.25 + 0.5) as a, floor(n * 0.75 + 0.5) as b from dense) group by page_id, crop)""",
        _PIXELS, _crops("whole", "left", "slim", "cell", "cut"), _DENSITIES,
    ),
    "hard_rules": _with(
        """select page_id, crop, multi, case when w >= 750 and h >= 1000 then 'too_large' when w * h / 2000000.0 > 0.35 then 'card_too_large' when w / h::double > 3.2 then 'horizontal_bar' when multi then 'multi_card_crop' end as rule from (
  select s.page_id, s.crop, tall > 3.0 or coalesce(n, 0) >= 3 or (tall > 1.7 and coalesce(n, 0) >= 2) as multi, 100 * (1 + s.page_id % 11) as w, 100 * (1 + s.page_id % 13) as h
  from (select page_id, crop, any_value(h) / any_value(w)::double as tall from cut group by page_id, crop) s left join counted c on c.page_id = s.page_id and c.crop = s.crop)""",
        _PIXELS, _crops("whole", "left", "slim", "strip", "cut"), _DENSITIES,
        """lows as (
  select page_id, crop, min(i) as s, max(i) as e from (select *, i - row_number() over (partition by page_id, crop order by i) as k from dense where axis = 'row' and d < 0.02) group by page_id, crop, k, n
  having max(i) - min(i) + 1 >= greatest(4, floor(n * 0.02 + 0.5))
), edges as (
  select page_id, crop, s, e from lows union all select distinct page_id, crop, -1, -1 from dense union all select distinct page_id, crop, n, n from dense where axis = 'row'
), bands as (
  select * from (select page_id, crop, e + 1 as a, lead(s) over (partition by page_id, crop order by s, e) - 1 as b from edges) where b >= a
), counted as (
  select page_id, crop, count(*) as n from (
    select b.page_id, b.crop, b.a from bands b join dense d on d.page_id = b.page_id and d.crop = b.crop and axis = 'row' and i between a and b
    group by b.page_id, b.crop, b.a, b.b having b.b - b.a + 1 >= greatest(8, floor(any_value(d.n) * 0.18 + 0.5)) and avg(d) >= 0.06) group by page_id, crop
)""",
    ),
    "refined_boxes": _with(
        """select page_id, way::int as way, case when changed then nx else x end as x, case when changed then ny else y end as y, case when changed then nw else w end as width, case when changed then nh else h end as height, changed,
  case when changed then 'snap_to_card_boundary' else reason end as reason from (
  select *, reason is null and overlap / (w * h + nw * nh - overlap) <= 0.95 as changed from (
    select *, case when cx < 0 or cx >= r - l or cy < 0 or cy >= b - t then 'center_outside' when ex <= sx or ey <= sy then 'empty_refined' when nw * nh < w * h * 0.7 then 'refined_too_small' when nw * nh > w * h * 1.4 then 'refined_too_large' end as reason,
      greatest(0, least(x + w, nx + nw) - greatest(x, nx)) * greatest(0, least(y + h, ny + nh) - greatest(y, ny)) as overlap from snapped))""",
        _PIXELS,
        """asked as (
  select page_id, way, (4 + dx)::double as x, (3 + dy)::double as y, (22 + page_id % 5 + dw)::double as w, (10 + page_id % 4 + dh)::double as h
  from pages, (values (0, -1, -1, 2, 2), (1, 1, 1, 0, 0), (2, -3, 0, 9, 1), (3, 2, 2, -4, -4), (4, -2, -2, 30, 20)) as t(way, dx, dy, dw, dh)
), wide as (
  select *, greatest(0, floor(x + 0.5) - floor(w * 0.12 + 0.5)) as l, greatest(0, floor(y + 0.5) - floor(h * 0.12 + 0.5)) as t, least(60, floor(x + w + 0.5) + floor(w * 0.12 + 0.5)) as r, least(48, floor(y + h + 0.5) + floor(h * 0.12 + 0.5)) as b from asked
), middles as (select *, floor(x + w / 2 - l + 0.5) as cx, floor(y + h / 2 - t + 0.5) as cy from wide
), lowx as (
  select page_id, way, p.x - l as i from middles m join px p using (page_id) where p.x >= l and p.x < r and p.y >= t and p.y < b group by page_id, way, p.x, l having avg((not white)::int) < 0.04
), lowy as (
  select page_id, way, p.y - t as i from middles m join px p using (page_id) where p.x >= l and p.x < r and p.y >= t and p.y < b group by page_id, way, p.y, t having avg((not white)::int) < 0.04
), ends as (
  select m.*, coalesce((select max(i) from lowx z where z.page_id = m.page_id and z.way = m.way and i <= cx), -1) + 1 as sx, coalesce((select min(i) from lowx z where z.page_id = m.page_id and z.way = m.way and i >= cx), r - l) - 1 as ex,
    coalesce((select max(i) from lowy z where z.page_id = m.page_id and z.way = m.way and i <= cy), -1) + 1 as sy, coalesce((select min(i) from lowy z where z.page_id = m.page_id and z.way = m.way and i >= cy), b - t) - 1 as ey from middles m
), near as (
  select *, floor(w * 0.15 + 0.5) as gx, floor(h * 0.15 + 0.5) as gy, l + sx as ax, t + sy as ay, greatest(1, ex - sx + 1) as px, greatest(1, ey - sy + 1) as py from ends
), shifted as (
  select *, least(greatest(ax, floor(x + 0.5) - gx), floor(x + 0.5) + gx) as mx, least(greatest(ay, floor(y + 0.5) - gy), floor(y + 0.5) + gy) as my from near
), sized as (
  select *, greatest(1, least(greatest(mx + px, floor(x + w + 0.5) - gx), floor(x + w + 0.5) + gx) - mx) as qx, greatest(1, least(greatest(my + py, floor(y + h + 0.5) - gy), floor(y + h + 0.5) + gy) - my) as qy from shifted
), snapped as (
  select *, greatest(0, least(59, mx))::double as nx, greatest(0, least(47, my))::double as ny, greatest(1, least(60 - greatest(0, least(59, mx)), qx))::double as nw, greatest(1, least(48 - greatest(0, least(47, my)), qy))::double as nh from sized
)""",
    ),
    "product_images": _with(
        """select page_id, piece, side::bigint as side, side >= 150 and white <= 0.92 as valid from (
  select page_id, piece, case piece when 'white' then 40 when 'low' then 140 else n end as side, case piece when 'white' then 1.0 when 'corner' then 1 - (n - 40) * 160 / (200.0 * n) else 0 end as white
  from (select distinct page_id, 130 + page_id % 40 as n from v_box), (select unnest(['cell', 'white', 'corner', 'low']) as piece))""",
    ),
    "heuristic_detector": _with(
        """select page_id, (40 + 370 * c)::int as x, (40 + 310 * r)::int as y, 320 as width, 280 as height, 0.75::double as confidence, round(0.3 + 0.2 * (2.5 * (161 * 141 / (320 * 280)::double) + 2) + 0.1, 6) as quality_score, true as is_searchable, null::varchar as reject_reason from cells""",
        _CELLS,
    ),
    "vision_runner": _with(
        """select page_id, (r * (1 + page_id % 2) + c) * 3 + k as candidate_id, (370 * c + case when k = 0 then 10 else 100 end)::int as x, (310 * r + case when k = 0 then 10 else 100 end)::int as y, case when k = 0 then 380 else 20 end as width, case when k = 0 then 340 else 20 end as height,
  0.9::double as confidence, case when k = 0 then 0.95 else 0 end::double as quality_score, k = 0 as is_searchable, case when k = 2 then 'too_small' end as reject_reason, 'VISION_BOXES_CHEAP' as source_detector from cells, (select unnest([0, 2]) as k)""",
        _CELLS,
    ),
}
