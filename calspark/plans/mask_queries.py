"""Queries on masks and regions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from calspark.functions.columns import rounded
from calspark.operators import masks as M
from calspark.operators import rois as S
from calspark.operators.extraction import extract
from calspark.operators.interactive import with_values
from calspark.plans import carriers as C
from calspark.plans.trace_queries import R, _r

DIAMETER = (3.0, 4.0)


def mask_overlap_flags(spark, d):
    return M.overlap_flags(C.masks(spark, d)).select("roi", "y", "x", "overlap")


def mask_normalise(spark, d):
    return _r(M.normalised(C.masks(spark, d)), "lam")


def mask_drop_overlap(spark, d):
    return _r(M.cell_masks(C.tile_masks(spark, d)).select("roi", "y", "x", "lam"), "lam")


def mask_iou_pairs(spark, d):
    return _r(M.iou_pairs(C.masks(spark, d)), "iou")


def mask_cosine_pairs(spark, d):
    return _r(M.cosine_pairs(C.masks(spark, d)), "cosine")


def mask_max_iou(spark, d):
    return _r(M.max_iou(C.masks(spark, d)), "iou")


def mask_max_weight_map(spark, d):
    return M.max_weight_map(C.masks(spark, d))


def mask_top3_per_pixel(spark, d):
    return M.top_per_pixel(C.masks(spark, d)).select("y", "x", "rank", "roi", "lam")


def mask_label_image(spark, d):
    return M.label_image(C.tile_masks(spark, d))


def mask_union_merge(spark, d):
    groups = C.masks(spark, d).select("roi").distinct().withColumn("group", F.expr("roi - roi % 3"))
    return M.union_merged(C.masks(spark, d), groups)


def overlap_greedy_filter(spark, d):
    return M.greedy_overlap_filter(C.tile_masks(spark, d).withColumn("plane", F.col("roi") % 4), 0.5)


def roi_median_pixel(spark, d):
    return S.median_pixel(C.masks(spark, d).withColumn("ord", F.col("y") * 64 + F.col("x")))


def roi_in_rectangle(spark, d):
    return S.in_rectangle(roi_median_pixel(spark, d), 10, 20, 20, 44)


def roi_gaussian_fit(spark, d):
    return _r(S.gaussian_fit(C.masks(spark, d), *DIAMETER), "my", "mx", "radius", "aspect")


def roi_compactness(spark, d):
    return _r(S.compactness(C.tile_masks(spark, d), *DIAMETER), "mrs", "mrs0", "compact")


def roi_soma_crop(spark, d):
    return S.soma_crop(C.masks(spark, d).withColumn("ord", F.col("y") * 64 + F.col("x"))).groupBy("roi").agg(F.sum(F.col("soma").cast("long")).alias("npix_soma"), F.count(F.lit(1)).alias("npix"))


def _sizes(spark, d):
    return C.masks(spark, d).groupBy("roi").agg(F.count(F.lit(1)).alias("npix"))


def roi_npix_norm(spark, d):
    return _r(S.npix_norm(_sizes(spark, d)), "npix_norm")


def roi_size_filter(spark, d):
    return _r(S.size_filtered(_sizes(spark, d), 0.98, 1.02), "npix_norm")


def roi_stats(spark, d):
    x = S.roi_stats(C.masks(spark, d).withColumn("ord", F.col("y") * 64 + F.col("x")), *DIAMETER)
    x = x.select("roi", F.col("med.y").alias("med_y"), F.col("med.x").alias("med_x"), *[c for c in x.columns if c not in ("roi", "med")])
    return _r(x, "mrs", "mrs0", "compact", "radius", "aspect_ratio", "npix_norm", "npix_norm_no_crop")


def roi_dilate4(spark, d):
    return M.dilated(C.tile_masks(spark, d), C.SIDE, C.SIDE, 2)


def roi_spread9(spark, d):
    return _r(M.spread9(C.tile_masks(spark, d), C.SIDE, C.SIDE), "lam")


def roi_connected_component(spark, d):
    holes = C.tile_masks(spark, d).where("not (ord % 5 = 2)")
    return M.connected_component(holes).select("roi", "y", "x")


def roi_outline(spark, d):
    return M.outline(C.tile_masks(spark, d))


def neuropil_ring(spark, d):
    tiles = C.tile_masks(spark, d)
    return M.neuropil_rings(tiles, tiles, C.SIDE, C.SIDE, inner=1, least=40, extend=2)


def neuropil_ring_circular(spark, d):
    tiles = C.tile_masks(spark, d)
    return M.neuropil_rings(tiles, tiles, C.SIDE, C.SIDE, inner=1, least=40, extend=2, circular=True)


def cell_pixel_map(spark, d):
    m = C.masks(spark, d)
    return M.cell_pixels(m, 1.0, 50.0, (m.agg(F.max("y")).first()[0] or 0) + 1, 64)


def chan2_ratio(spark, d):
    image = C.pixels(spark, d).groupBy("y", "x").agg(F.avg(F.abs("v")).alias("v"))
    tiles = C.tile_masks(spark, d, C.SMALL_SIDE)
    ring = M.dilated(tiles, 8, 8, 1).join(tiles.select("roi", "y", "x"), ["roi", "y", "x"], "left_anti")
    return _r(M.contrast(tiles, ring, image), "inside", "outside", "prob")


def drawn_regions(spark, d):
    """Traces of the suppliers' boxes and of an ellipse for every region of the world."""
    k = F.col("r_regionkey")
    shapes = C.table(spark, d, "region").select(k.alias("k"), (1.0 + k).alias("cy"), (6.0 - k).alias("cx"), F.lit(1.5).alias("ry"), F.lit(2.0).alias("rx"))
    m = M.normalised(M.with_drawn(C.tile_masks(spark, d, C.SMALL_SIDE), shapes, 8, 8))
    return extract(C.movie(spark, d), m, m.select("roi", "y", "x").where("false"), 8, lambda x: _r(x, "f")).select("plane", "roi", "frame", "f")


def roi_user_values(spark, d):
    """Balances, in the order of customers of least number, as a vector for the suppliers' boxes."""
    rois = C.table(spark, d, "supplier").select(F.col("s_suppkey").alias("roi"))
    c = C.table(spark, d, "customer").select((F.row_number().over(Window.orderBy("c_custkey")) - 1).alias("at"), F.col("c_acctbal").alias("v"))
    return with_values(rois, c.where(F.col("at") < rois.count()))


QUERIES = {f.__name__: f for f in (
    mask_overlap_flags, mask_normalise, mask_drop_overlap, mask_iou_pairs, mask_cosine_pairs, mask_max_iou, mask_max_weight_map, mask_top3_per_pixel, mask_label_image, mask_union_merge, overlap_greedy_filter,
    roi_median_pixel, roi_in_rectangle, roi_gaussian_fit, roi_compactness, roi_soma_crop, roi_npix_norm, roi_size_filter, roi_stats, roi_dilate4, roi_spread9, roi_connected_component, roi_outline, neuropil_ring, neuropil_ring_circular, cell_pixel_map, chan2_ratio, drawn_regions, roi_user_values,
)}

DY, DX = DIAMETER
_DISK = ", ".join(f"({n}, cast({v!r} as double))" for n, v in enumerate(S.disk_distances(*DIAMETER), 1))
_MED = """med as (select roi, arg_min({'y': y, 'x': x}, (power(y - my, 2) + power(x - mx, 2)) * 1e6 + y * 64 + x) p from masks join (select roi, quantile_cont(y, 0.5) my, quantile_cont(x, 0.5) mx from masks group by roi) q using (roi) group by roi)"""
_DIL = "{b} as (select distinct roi, y + dy y, x + dx x from {a}, (values (0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)) s(dy, dx) where y + dy between 0 and {h} and x + dx between 0 and {h})"
_PAIRS = "pairs as (select p.roi a, q.roi b, count(*) inter, sum(p.lam * q.lam) dot from masks p join masks q on p.y = q.y and p.x = q.x and p.roi < q.roi group by 1, 2)"
_IOU = f"{_PAIRS}, sz as (select roi, count(*) n, sqrt(sum(lam * lam)) nrm from masks group by roi), iou as (select a, b, inter, inter / (x.n + y.n - inter) iou, dot / (x.nrm * y.nrm) cosine from pairs join sz x on x.roi = a join sz y on y.roi = b)"

ORACLES = {
    "mask_overlap_flags": f"with {C.MASKS} select roi, y, x, count(*) over (partition by y, x) > 1 overlap from masks",
    "mask_normalise": f"with {C.MASKS} select roi, y, x, {R('lam / sum(lam) over (partition by roi)')} lam from masks",
    "mask_drop_overlap": f"with {C.TILES}, k as (select *, count(*) over (partition by y, x) n from tiles) select roi, y, x, {R('lam / sum(lam) over (partition by roi)')} lam from k where n = 1",
    "mask_iou_pairs": f"with {C.MASKS}, {_IOU} select a, b, inter, {R('iou')} iou from iou",
    "mask_cosine_pairs": f"with {C.MASKS}, {_IOU} select a, b, {R('cosine')} cosine from iou",
    "mask_max_iou": f"with {C.MASKS}, {_IOU} select roi, {R('coalesce(max(iou), 0)')} iou from (select distinct roi from masks) left join (select a roi, iou from iou union all select b, iou from iou) using (roi) group by roi",
    "mask_max_weight_map": f"with {C.MASKS} select y, x, max(lam) lam, arg_min(roi, -lam * 1000000 + roi) roi from masks group by y, x",
    "mask_top3_per_pixel": f"with {C.MASKS} select y, x, row_number() over (partition by y, x order by lam desc, roi) rank, roi, lam from masks qualify rank <= 3",
    "mask_label_image": f"with {C.TILES} select y, x, max(roi) roi from tiles group by y, x having count(*) = 1",
    "mask_union_merge": f"with {C.MASKS} select roi - roi % 3 roi, y, x, arg_min(lam, roi) lam from masks group by all",
    "roi_median_pixel": f"with {C.MASKS}, {_MED} select roi, p.y, p.x from med",
    "roi_in_rectangle": f"with {C.MASKS}, {_MED} select roi, p.y, p.x from med where p.y >= 10 and p.y < 20 and p.x >= 20 and p.x < 44",
    "roi_gaussian_fit": f"""with {C.MASKS}, s as (select roi, sum(lam) s, sum(lam * y / {DY}) / sum(lam) my, sum(lam * x / {DX}) / sum(lam) mx from masks group by roi),
v as (select roi, max(my) my, max(mx) mx, sum(lam * power(y / {DY} - my, 2)) / max(s) a, sum(lam * power(x / {DX} - mx, 2)) / max(s) b, sum(lam * (y / {DY} - my) * (x / {DX} - mx)) / max(s) c from masks join s using (roi) group by roi),
e as (select *, 2 * sqrt((a + b) / 2 + sqrt(power((a - b) / 2, 2) + c * c)) r1, 2 * sqrt(greatest((a + b) / 2 - sqrt(power((a - b) / 2, 2) + c * c), 0)) r2 from v)
select roi, {R(f"my * {DY}")} my, {R(f"mx * {DX}")} mx, {R(f"r1 * {(DY + DX) / 2}")} radius, {R("2 * r1 / (0.01 + r1 + r2)")} aspect from e""",
    "roi_compactness": f"""with {C.TILES}, disk(n, v) as (values {_DISK}), q as (select roi, quantile_cont(y, 0.5) my, quantile_cont(x, 0.5) mx, count(*) n from tiles group by roi),
s as (select roi, avg(sqrt(power((y - my) / {DY}, 2) + power((x - mx) / {DX}, 2))) mrs, max(n) n from tiles join q using (roi) group by roi),
z as (select roi, max(mrs) mrs, avg(v) mrs0 from s join disk on disk.n <= s.n group by roi) select roi, {R('mrs')} mrs, {R('mrs0')} mrs0, {R('greatest(1.0, mrs / (1e-10 + mrs0))')} compact from z""",
    "roi_soma_crop": f"""with {C.MASKS}, {_MED}, x as (select m.*, sqrt(power(y - p.y, 2) + power(x - p.x, 2)) dist from masks m join med using (roi)),
far as (select roi, max(dist) far, count(*) n from x group by roi), g as (select roi, unnest(range(0, cast(greatest(ceil(far), 1) as bigint))) k from far),
w as (select roi, cast(floor(dist) as bigint) k, sum(lam) w from x group by 1, 2), r as (select roi, k, coalesce(w, 0) w, max(k) over (partition by roi) lastk from g left join w using (roi, k)),
i as (select *, max(w) over (partition by roi) / 3 top from r where k < lastk), f as (select roi, min(k) ida from i where w > top group by roi),
c as (select roi, min(k) cut from i join f using (roi) where k >= ida and w < top group by roi),
rad as (select roi, case when n > 10 then coalesce(cut, greatest(ceil(far) - 1, 0)) end radius from far left join c using (roi)),
y as (select roi, coalesce(dist < radius, true) soma from x join rad using (roi))
select roi, case when count(*) filter (soma) = 0 then count(*) else count(*) filter (soma) end npix_soma, count(*) npix from y group by roi""",
    "roi_npix_norm": f"with {C.MASKS}, s as (select roi, count(*) npix from masks group by roi), q as (select quantile_cont(npix, 0.5) m from (select npix from s order by roi limit 100)) select roi, {R('npix / (m + 1e-10)')} npix_norm from s, q",
    "roi_size_filter": f"with {C.MASKS}, s as (select roi, count(*) npix from masks group by roi), q as (select quantile_cont(npix, 0.5) m from (select npix from s order by roi limit 100)) select roi, {R('npix / (m + 1e-10)')} npix_norm from s, q where npix / (m + 1e-10) between 0.98 and 1.02",
    "roi_dilate4": f"with {C.TILES}, {_DIL.format(a='tiles', b='d1', h=C.SIDE - 1)}, {_DIL.format(a='d1', b='d2', h=C.SIDE - 1)} select roi, y, x from d2",
    "roi_spread9": f"with {C.TILES} select roi, cast(y + dy as int) y, cast(x + dx as int) x, {R('sum(lam / 3)')} lam from tiles, range(-1, 2) p(dy), range(-1, 2) q(dx) where y + dy between 0 and {C.SIDE - 1} and x + dx between 0 and {C.SIDE - 1} group by 1, 2, 3",
    "roi_connected_component": f"""with recursive {C.TILES}, h as (select * from tiles where ord % 5 <> 2), seed as (select roi, arg_max(y, lam * 1000 - ord / 1000.0) y, arg_max(x, lam * 1000 - ord / 1000.0) x from h group by roi),
walk as (select * from seed union select h.roi, h.y, h.x from walk w join h on h.roi = w.roi and abs(h.y - w.y) + abs(h.x - w.x) = 1) select roi, y, x from walk""",
    "roi_outline": f"with {C.TILES} select roi, y, x from tiles t where (select count(*) from tiles u where u.roi = t.roi and abs(u.y - t.y) + abs(u.x - t.x) = 1) < 4",
    "neuropil_ring": f"""with {C.TILES}, {_DIL.format(a='tiles', b='ring', h=C.SIDE - 1)}, cell as (select distinct y, x from tiles),
free as (select cast(a.i as int) y, cast(b.i as int) x from range({C.SIDE}) a(i), range({C.SIDE}) b(i) where (a.i, b.i) not in (select (y, x) from cell)),
bx as (select roi, min(y) y0, max(y) y1, min(x) x0, max(x) x1 from ring group by roi), nr as (select roi, count(*) nr from ring join free using (y, x) group by roi),
need as (select roi, y, x, greatest(1, ceil(greatest(y0 - y, y - y1, x0 - x, x - x1) / 2.0)) k from bx, free),
cum as (select roi, k, sum(count(*)) over (partition by roi order by k) n from need group by roi, k),
kk as (select roi, coalesce(min(k) filter (n - coalesce(nr, 0) > 40), 100) kk from cum left join nr using (roi) group by roi)
select roi, y, x from need join kk using (roi) where k <= kk and (roi, y, x) not in (select (roi, y, x) from ring)""",
    "chan2_ratio": f"""with {C.SMALL_TILES}, {C.PIXELS}, img as (select y, x, avg(abs(v)) v from pixels group by 1, 2), {_DIL.format(a='tiles', b='d1', h=7)},
ins as (select roi, greatest(sum(lam * v) / sum(lam), 1e-3) i from tiles join img using (y, x) group by roi), outs as (select roi, avg(v) o from d1 join img using (y, x) where (roi, y, x) not in (select (roi, y, x) from tiles) group by roi)
select roi, {R('i')} inside, {R('o')} outside, {R('i / (i + o)')} prob from ins join outs using (roi)""",
}

_SOMA = ORACLES["roi_soma_crop"].split("select roi, case when n > 10")[0]
ORACLES["roi_stats"] = f"""{_SOMA}select roi, case when n > 10 then coalesce(cut, greatest(ceil(far) - 1, 0)) end radius from far left join c using (roi)),
y0 as (select x.*, coalesce(dist < radius, true) inn from x join rad using (roi)), y as (select roi, y, x, lam, inn or not bool_or(inn) over (partition by roi) soma from y0),
sz as (select roi, count(*) npix, count(*) filter (soma) npix_soma from y group by roi), nn as (select *, row_number() over (order by roi) nth from sz),
nm as (select quantile_cont(npix, 0.5) filter (nth <= 100) a, quantile_cont(npix_soma, 0.5) filter (nth <= 100) b from nn),
i2 as (select roi, y, x, lam from y where soma), disk(n, v) as (values {_DISK}), dk as (select n, avg(v) over (order by n) v from disk),
q2 as (select roi, quantile_cont(y, 0.5) my, quantile_cont(x, 0.5) mx, least(count(*), (select count(*) from disk)) n from i2 group by roi),
cp as (select roi, avg(sqrt(power((y - my) / {DY}, 2) + power((x - mx) / {DX}, 2))) mrs, max(n) n from i2 join q2 using (roi) group by roi), cq as (select roi, mrs, v mrs0 from cp join dk using (n)),
s1 as (select roi, sum(lam) s, sum(lam * y / {DY}) / sum(lam) my, sum(lam * x / {DX}) / sum(lam) mx from i2 group by roi),
v1 as (select roi, sum(lam * power(y / {DY} - my, 2)) / max(s) a, sum(lam * power(x / {DX} - mx, 2)) / max(s) b, sum(lam * (y / {DY} - my) * (x / {DX} - mx)) / max(s) c from i2 join s1 using (roi) group by roi),
e1 as (select roi, 2 * sqrt((a + b) / 2 + sqrt(power((a - b) / 2, 2) + c * c)) r1, 2 * sqrt(greatest((a + b) / 2 - sqrt(power((a - b) / 2, 2) + c * c), 0)) r2 from v1)
select roi, p.y med_y, p.x med_x, npix, npix_soma, {R('mrs')} mrs, {R('mrs0')} mrs0, {R('greatest(1.0, mrs / (1e-10 + mrs0))')} compact, {R(f"r1 * {(DY + DX) / 2}")} radius, {R("2 * r1 / (0.01 + r1 + r2)")} aspect_ratio,
  {R('npix_soma / (b + 1e-10)')} npix_norm, {R('npix / (a + 1e-10)')} npix_norm_no_crop from sz join med using (roi) join cq using (roi) join e1 using (roi), nm"""
ORACLES["neuropil_ring_circular"] = f"""with {C.TILES}, cell as (select distinct y, x from tiles),
fa as (select t.roi, cast(a.i as int) y, cast(b.i as int) x, min(abs(a.i - t.y) + abs(b.i - t.x)) far from tiles t, range({C.SIDE}) a(i), range({C.SIDE}) b(i) group by 1, 2, 3),
fr as (select *, greatest(0, ceil((far - 1) / 2.0)) k from fa where (y, x) not in (select (y, x) from cell)),
ku as (select roi, k, sum(count(*)) over (partition by roi order by k) n, sum(count(*) filter (far <= 1)) over (partition by roi) ins from fr group by roi, k),
kk as (select roi, coalesce(min(k) filter (n - ins > 40), 100) kk from ku group by roi) select roi, y, x from fr join kk using (roi) where far > 1 and k <= kk"""
ORACLES["cell_pixel_map"] = f"""with {C.MASKS}, f as (select max(y) + 1 h from masks), pk as (select y, x, max(lam) v from masks group by 1, 2), o as (select i.i - 2 k from range(5) i(i)),
nb as (select p.y, p.x, p.v, case when p.y + a.k < 0 then -1 - (p.y + a.k) when p.y + a.k >= h then 2 * h - 1 - (p.y + a.k) else p.y + a.k end yy, case when p.x + b.k < 0 then -1 - (p.x + b.k) when p.x + b.k >= 64 then 127 - (p.x + b.k) else p.x + b.k end xx from pk p, f, o a, o b),
ls as (select nb.y, nb.x, any_value(nb.v) v, list_sort(list(coalesce(q.v, 0))) l from nb left join pk q on q.y = nb.yy and q.x = nb.xx group by 1, 2) select y, x from ls where v >= l[13]"""
ORACLES["overlap_greedy_filter"] = f"""with recursive {C.TILES}, m as (select roi % 4 plane, roi, y, x from tiles), px as (select plane, y, x, list(roi) l from m group by 1, 2, 3),
rs as (select m.plane, m.roi, list(list_filter(l, lambda z: z <> m.roi)) others from m join px using (plane, y, x) group by 1, 2), o as (select *, row_number() over (partition by plane order by roi desc) n from rs),
st(plane, n, roi, gone) as (select distinct plane, cast(0 as bigint), cast(null as bigint), cast([] as bigint[]) from o union all
  select o.plane, o.n, o.roi, case when list_avg(list_transform(o.others, lambda l: case when len(list_filter(l, lambda z: not list_contains(st.gone, z))) > 0 then 1.0 else 0.0 end)) > 0.5 then list_append(st.gone, o.roi) else st.gone end from st join o on o.plane = st.plane and o.n = st.n + 1)
select plane, roi from st where n > 0 and not list_contains(gone, roi)"""
ORACLES["drawn_regions"] = f"""with {C.SMALL_TILES}, {C.PIXELS}, dr as (select r_regionkey k, cast(p.i as int) y, cast(q.i as int) x from region, range(8) p(i), range(8) q(i) where power((p.i - (1 + r_regionkey)) / 1.5, 2) + power((q.i - (6 - r_regionkey)) / 2.0, 2) <= 1),
nr as (select r_regionkey k, (select max(roi) from tiles) + row_number() over (order by r_regionkey) roi from region), al as (select roi, y, x, lam from tiles union all select roi, y, x, 1.0 / count(*) over (partition by k) from dr join nr using (k)),
m as (select roi, y, x, lam / sum(lam) over (partition by roi) lam from al) select plane, roi, frame, {R('sum(v * lam)')} f from pixels join m using (y, x) group by 1, 2, 3"""
ORACLES["roi_user_values"] = "with s as (select s_suppkey roi, row_number() over (order by s_suppkey) n from supplier), c as (select c_acctbal as value, row_number() over (order by c_custkey) n from customer) select roi, value from s join c using (n)"
