"""Queries: scalar functions, each over a whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridspark.functions import scalars as S
from gridspark.plans.registry import query
from gridspark.sources import views

C = F.col


@query("SELECT x, y, (((kind * 7 - level) % 16) + 16) % 16 AS mod16, floor(kind * level / 7.0::DOUBLE + 0.5)::BIGINT AS rounded, trunc(kind * level / 7.0::DOUBLE)::BIGINT AS truncated, floor(kind * level / 7.0::DOUBLE)::BIGINT AS floored, ceil(kind * level / 7.0::DOUBLE)::BIGINT AS ceiled, greatest(least(kind * level, 100), -50) AS clamped FROM g_dense")
def sc01_to_sc03_rounding(spark, d):
    v = C("kind") * C("level")
    q = v / F.lit(7.0)
    return views.g_dense(spark, d).select("x", "y", F.pmod(C("kind") * 7 - C("level"), F.lit(16).cast("long")).alias("mod16"), S.half_up(q).alias("rounded"), q.cast("long").alias("truncated"), F.floor(q).alias("floored"), F.ceil(q).alias("ceiled"), S.clamp(v, 100 * 0 - 50, 100).alias("clamped"))


@query("SELECT x, y, ((level::FLOAT * 0.3::FLOAT)::FLOAT + y::FLOAT)::FLOAT AS v FROM g_dense")
def sc04_f32(spark, d):
    return views.g_dense(spark, d).select("x", "y", S.f32(S.f32(S.f32(C("level")) * S.f32(F.lit(0.3))) + S.f32(C("y"))).alias("v"))


@query("SELECT x, y, level & 12 AS a, level | 3 AS o, xor(level, 85) AS e, level << 3 AS l, level >> 2 AS r, (level >> 4) & 1 AS bit, bit_count(level)::INT AS ones, (x << 16) | (y << 8) | level AS packed FROM g_dense")
def sc05_bits(spark, d):
    v = C("level")
    packed = F.shiftleft(C("x"), 16).bitwiseOR(F.shiftleft(C("y").cast("long"), 8)).bitwiseOR(v)
    return views.g_dense(spark, d).select("x", "y", v.bitwiseAND(12).alias("a"), v.bitwiseOR(3).alias("o"), v.bitwiseXOR(85).alias("e"), F.shiftleft(v, 3).alias("l"), F.shiftright(v, 2).alias("r"), F.getbit(v, F.lit(4)).cast("long").alias("bit"), F.bit_count(v).alias("ones"), packed.alias("packed"))


@query("SELECT doc_id, hex(encode(source)) AS h, decode(unhex(hex(encode(text)))) = text AS back, octet_length(encode(text))::INT AS bytes, sha256(text) AS sha FROM documents")
def sc06_sc07_bytes(spark, d):
    data = C("text").cast("binary")
    return views.table(spark, d, "documents").select("doc_id", F.hex(C("source").cast("binary")).alias("h"), (F.decode(F.unhex(F.hex(data)), "UTF-8") == C("text")).alias("back"), F.octet_length(data).alias("bytes"), F.sha2(data, 256).alias("sha"))


#: CRC-32 of each source's name, bit by bit.
CRC_SQL = """, d AS (SELECT DISTINCT source, encode(source) AS data FROM documents), b AS (SELECT source, octet_length(data) AS n, ('0x' || hex(data[1 + i:1 + i]))::BIGINT AS byte, i FROM (SELECT *, unnest(range(0, octet_length(data))) AS i FROM d)),
w AS (SELECT source, list(byte ORDER BY i) AS bytes FROM b GROUP BY source)
SELECT doc_id, xor(list_reduce(list_prepend(4294967295, bytes), lambda c, v: list_reduce(list_prepend(xor(c, v), range(0, 8)), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)), 4294967295)::BIGINT AS crc FROM documents JOIN w USING (source)"""


@query(CRC_SQL)
def sc07_crc32(spark, d):
    """CRC-32 of each document's source; the SQL computes it bit by bit."""
    return views.table(spark, d, "documents").select("doc_id", F.crc32(C("source").cast("binary")).alias("crc"))


#: The same byte by byte, with the 256 remainders of single bytes.
TEXT_CRC_SQL = """, t AS (SELECT list(list_reduce(list_prepend(i, range(0, 8)), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) ORDER BY i) AS tab FROM range(0, 256) r(i)),
b AS (SELECT doc_id, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: ('0x' || h)::BIGINT) AS bytes FROM documents)
SELECT doc_id, xor(list_reduce(list_prepend(4294967295, bytes), lambda c, v: xor(c >> 8, tab[1 + (xor(c, v) & 255)])), 4294967295)::BIGINT AS crc FROM b, t"""


@query(TEXT_CRC_SQL)
def sc07_crc32_of_texts(spark, d):
    """CRC-32 of each whole text."""
    return views.table(spark, d, "documents").select("doc_id", F.crc32(C("text").cast("binary")).alias("crc"))


@query("SELECT p_partkey, concat(lower(regexp_replace(p_brand, '[^A-Za-z0-9]', '', 'g')), '_', p_size, '.png') AS asset, lower(regexp_replace(p_brand, '[^A-Za-z0-9]', '', 'g')) AS kind, p_size AS type FROM part")
def sc08_asset_names(spark, d):
    name = S.asset_name(F.lower(F.regexp_replace("p_brand", "[^A-Za-z0-9]", "")), C("p_size"))
    named = views.table(spark, d, "part").withColumn("asset", name)
    kind, number = S.parse_asset(C("asset"))
    return named.select("p_partkey", "asset", kind.alias("kind"), number.alias("type"))


@query("SELECT event_id, (props->>'k')::INT AS k, '{\"k\":' || (props->>'k') || ',\"t\":\"' || event_type || '\"}' AS out, len(list_filter(json_keys(props), lambda k: k <> 'z'))::INT AS unknown FROM events")
def sc09_json(spark, d):
    k = F.from_json("props", "k int")["k"]
    return views.table(spark, d, "events").select("event_id", k.alias("k"), F.to_json(F.struct(k.alias("k"), C("event_type").alias("t"))).alias("out"), F.size(S.unknown_keys(C("props"), ["z"])).alias("unknown"))


@query("SELECT vec_id, embedding[1]::DOUBLE AS first, len(embedding)::INT AS size, list_sort(embedding)[1]::DOUBLE AS least, len(list_filter(embedding, lambda v: v > 0.4)) > 0 AS any_high, len(list_filter(embedding, lambda v: v <= -0.6)) = 0 AS none_low, label AS via_map FROM embeddings")
def sc10_arrays(spark, d):
    e = C("embedding")
    via = F.element_at(F.map_from_entries(F.array(F.struct(F.lit("label"), C("label")))), "label")
    return views.table(spark, d, "embeddings").select("vec_id", F.element_at(e, 1).cast("double").alias("first"), F.size(e).alias("size"), F.element_at(F.array_sort(e), 1).cast("double").alias("least"), F.exists(e, lambda v: v > 0.4).alias("any_high"), F.forall(e, lambda v: v > -0.6).alias("none_low"), via.alias("via_map"))


@query("SELECT x, y, ((((kind + 3) * 1024 + level) * 32 + y % 32) * 6 + x % 6) * 32 + (x * 5 + y) % 32 AS recipe, (kind + 3)::BIGINT AS kind, level AS type, (y % 32)::BIGINT AS variant, x % 6 AS shape, (x * 5 + y) % 32 AS paint FROM g_dense")
def sc11_recipe(spark, d):
    recipe = S.recipe_id(kind=C("kind") + 3, type=C("level"), variant=C("y") % 32, shape=C("x") % 6, paint=(C("x") * 5 + C("y")) % 32)
    cells = views.g_dense(spark, d).select("x", "y", recipe.alias("recipe"))
    return cells.withColumns(S.recipe_decode(C("recipe")))


@query("SELECT seq, concat(asset, ':', kind, ':', dw, ':', dh) AS k FROM cmds")
def sc12_frame_key(spark, d):
    return views.cmds(spark, d).select("seq", S.frame_key(["asset", "kind", "dw", "dh"]).alias("k"))


#: The colours of paints 1 to 12 as (red, green, blue): a the strongest channel, b the weakest, c their mean.
LETTERS = "['abb', 'acb', 'aab', 'cab', 'bab', 'bac', 'baa', 'bca', 'bba', 'cba', 'aba', 'abc']"
PAINT_SQL = f""", p AS (SELECT x, y, r, g, b, (x + y) % 33 AS paint, (x * 7 + y) % 64 AS type, r / 255.0::DOUBLE AS dr, g / 255.0::DOUBLE AS dg, b / 255.0::DOUBLE AS db FROM pix),
h AS (SELECT *, greatest(dr, dg, db) AS hi, least(dr, dg, db) AS lo, CASE WHEN paint BETWEEN 1 AND 24 THEN {LETTERS}[(paint - 1) % 12 + 1] END AS letters FROM p),
u AS (SELECT *, CASE WHEN paint <= 12 THEN lo ELSE 0.4::FLOAT::DOUBLE * lo END AS weak, hi - lo AS span FROM h),
m AS (SELECT *, CASE WHEN span = 0 THEN 0 ELSE CASE WHEN hi = dr THEN (dg - db) / span WHEN hi = dg THEN (db - dr) / span + 2 ELSE (dr - dg) / span + 4 END / 6 END AS sector, CASE WHEN hi = 0 THEN 0 ELSE span / hi END AS sat FROM u),
v AS (SELECT *, sector - floor(sector) AS hue FROM m),
s AS (SELECT *, paint BETWEEN 1 AND 12 AND ((type IN (0, 2, 23) AND hue BETWEEN 0.03::FLOAT::DOUBLE AND 0.08::FLOAT::DOUBLE AND sat BETWEEN 0.38::FLOAT::DOUBLE AND 0.53::FLOAT::DOUBLE)
    OR (type IN (59, 60) AND (hue + 0.5) % 1 BETWEEN 0.42::FLOAT::DOUBLE AND 0.55::FLOAT::DOUBLE AND sat BETWEEN 0.2::FLOAT::DOUBLE AND 0.27::FLOAT::DOUBLE)) AS spared FROM v)"""


def _channel_sql(k: int, name: str, spared: str, wall: bool = False) -> str:
    d = ("dr", "dg", "db")[k]
    brown = ("hi", "0.7::FLOAT::DOUBLE * hi", "0.49::FLOAT::DOUBLE * hi")[k]
    negative = f"greatest(0, 0.75 - {d} * 2)" if wall else f"1 - {d}"
    return f"""floor(least(1.0, greatest(0.0, CASE WHEN paint IN (0, 31) OR {spared} THEN {d} WHEN paint <= 24 THEN CASE substr(letters, {k + 1}, 1) WHEN 'a' THEN hi WHEN 'b' THEN weak ELSE (hi + weak) * 0.5 END
    WHEN paint = 25 THEN 0.15::FLOAT::DOUBLE * (hi + lo) WHEN paint = 26 THEN (hi * 7 + lo * 3) * 0.1::FLOAT::DOUBLE * (2 - (hi + lo) * 0.5) WHEN paint = 27 THEN (hi + lo) * 0.5 WHEN paint = 28 THEN {brown}
    WHEN paint = 29 THEN 0.025::FLOAT::DOUBLE * (hi + lo) WHEN paint = 30 THEN CASE WHEN hi = 0 THEN {d} ELSE {negative} END END)) * 255 + 0.5)::INT AS {name}"""


def _painted_sql(k: int, name: str, spared: str, wall: bool = False) -> str:
    """Null for paint 32, which doesn't exist."""
    value, _, alias = _channel_sql(k, name, spared, wall).rpartition(" AS ")
    return f"CASE WHEN paint <= 31 THEN {value} END AS {alias}"


@query(PAINT_SQL + " SELECT x, y, " + ", ".join(_painted_sql(k, n, "spared") for k, n in enumerate(("pr", "pg", "pb"))) + ", " + ", ".join(_painted_sql(k, n, "FALSE", True) for k, n in enumerate(("wr", "wg", "wb"))) + " FROM s")
def sc13_paint_color(spark, d):
    """Tiles with the masks of their types, and walls."""
    rgb, paint, type_ = (C("r"), C("g"), C("b")), (C("x") + C("y")) % 33, (C("x") * 7 + C("y")) % 64
    tile, wall = S.paint_color(*rgb, paint, spared=S.paint_spares(*rgb, type_)), S.paint_color(*rgb, paint, wall=True)
    painted = views.pix(spark, d).withColumns({"c": tile, "w": wall})
    return painted.select("x", "y", *[C(f"c.{k}").alias(f"p{k}") for k in "rgb"], *[C(f"w.{k}").alias(f"w{k}") for k in "rgb"])


@query(PAINT_SQL + " SELECT x, y, hue BETWEEN 0.2 AND 0.6 AND sat BETWEEN 0.3 AND 0.9 AS hit, NOT ((hue + 0.75) % 1 BETWEEN 0.1 AND 0.5 AND sat BETWEEN 0.0 AND 0.6) AS inverted, (hue - 0.5) % 1 BETWEEN -0.3 AND 0.1 AND sat <= 0.8 AS negative, CASE WHEN paint = 32 THEN 'unknown paint' WHEN paint BETWEEN 1 AND 12 AND type = 5 THEN 'tree' END AS reason FROM s")
def sc14_hue_sat_mask(spark, d):
    rgb = C("r"), C("g"), C("b")
    masks = {"hit": S.hue_sat_mask(*rgb, 0.2, 0.6, 0.3, 0.9), "inverted": S.hue_sat_mask(*rgb, 0.1, 0.5, 0.0, 0.6, 0.75, True), "negative": S.hue_sat_mask(*rgb, -0.3, 0.1, 0.0, 0.8, -0.5)}
    reason = S.paint_reason((C("x") * 7 + C("y")) % 64, (C("x") + C("y")) % 33)
    return views.pix(spark, d).select("x", "y", *[c.alias(n) for n, c in masks.items()], reason.alias("reason"))


@query("SELECT x, y, floor(r * g / 255.0::DOUBLE + 0.5)::INT AS product, least(r, a) AS over, r - least(r, a) AS additive FROM pix")
def sc15_colors(spark, d):
    over, additive = S.split_premultiplied(C("r"), C("a"))
    return views.pix(spark, d).select("x", "y", S.multiply_color(C("r"), C("g")).alias("product"), over.alias("over"), additive.alias("additive"))


@query("SELECT x, y, ceil(level / 255.0::DOUBLE * 16)::INT AS height FROM g_dense")
def sc16_fill_height(spark, d):
    return views.g_dense(spark, d).select("x", "y", S.fill_height(C("level")).alias("height"))


@query("SELECT x, y, (CASE WHEN level % 16 = 15 THEN 15 + [[2, 0, 0], [0, 1, 4], [0, 3, 0]][x % 3 + 1][y % 3 + 1] ELSE level % 16 END)::BIGINT AS variant FROM g_dense")
def sc17_wall_variant(spark, d):
    return views.g_dense(spark, d).select("x", "y", S.wall_variant(C("level") % 16, C("x"), C("y")).alias("variant"))


@query(
    """, q AS (SELECT x, y, level % 8 AS style, kind >= 0 AS day, level % 5 = 0 AS blood, level % 3 = 0 AS rain, x % 2 = 0 AS remix, (level % 9)::INT AS moon, (x * y % 60) * 1000.0::DOUBLE AS time, CASE WHEN x % 4 > 0 THEN (y % 3) / 2.0::DOUBLE END AS clouds FROM g_dense)
SELECT x, y, CASE WHEN style IN (2, 6) THEN FALSE WHEN style > 6 OR moon > 7 OR clouds IS NULL THEN NULL WHEN style = 0 THEN day WHEN style = 1 THEN NOT day WHEN style = 3 THEN NOT day AND (blood OR moon = 0)
    WHEN style = 4 THEN rain OR clouds > 0 ELSE (NOT rain OR CASE WHEN remix THEN y < 400 - 350 ELSE y > 30.5 END) AND time > 40500 END AS harvestable FROM q"""
)
def sc18_harvestable(spark, d):
    state = {
        "day_time": C("kind") >= 0, "blood_moon": C("level") % 5 == 0, "raining": C("level") % 3 == 0, "remix_world": C("x") % 2 == 0, "moon_phase": C("level") % 9, "time": (C("x") * C("y") % 60) * 1000.0,
        "cloud_alpha": F.when(C("x") % 4 > 0, (C("y") % 3) / 2), "world_surface": F.lit(30.5), "world_height": F.lit(400),
    }
    return views.g_dense(spark, d).select("x", "y", S.harvestable(C("level") % 8, C("y"), state).alias("harvestable"))


@query("SELECT x, y, CASE level % 7 WHEN 2 THEN '0,0;16,16;0,16' WHEN 3 THEN '0,16;16,0;16,16' WHEN 4 THEN '0,0;16,0;0,16' WHEN 5 THEN '0,0;16,0;16,16' END AS points FROM g_dense")
def sc19_polygon(spark, d):
    points = S.polygon_of(C("level") % 7)
    return views.g_dense(spark, d).select("x", "y", F.when(points.isNotNull(), F.concat_ws(";", F.transform(points, lambda p: F.concat_ws(",", p.cast("array<string>"))))).alias("points"))


@query("SELECT x, y, ((((kind + 3)::BIGINT * 1024 + level) * 32 + y % 32) * 6 + x % 6) * 32 AS recipe, ceil(level / 255.0::DOUBLE * 16)::INT AS height, (CASE WHEN level % 16 = 15 THEN 15 + [[2, 0, 0], [0, 1, 4], [0, 3, 0]][x % 3 + 1][y % 3 + 1] ELSE level % 16 END)::INT AS variant FROM g_dense")
def sql_functions(spark, d):
    """The registered SQL functions in use."""
    S.register_sql_functions(spark)
    return views.g_dense(spark, d).selectExpr("x", "y", "grid_recipe_id(kind + 3, cast(level AS int), y % 32, cast(x % 6 AS int), 0) AS recipe", "grid_fill_height(cast(level AS int)) AS height", "grid_wall_variant(cast(level % 16 AS int), x, y) AS variant")


@query(
    PAINT_SQL.replace("% 33", "% 32") + """, q AS (SELECT *, greatest(r, g, b)::DOUBLE AS t, (greatest(r, g, b) - least(r, g, b))::DOUBLE AS whole FROM s), k AS (SELECT *, CASE WHEN whole = 0 THEN 0 WHEN t = r THEN (g - b) / whole WHEN t = g THEN 2 + (b - r) / whole ELSE 4 + (r - g) / whole END AS part FROM q)
SELECT x, y, """ + _channel_sql(1, "green", "FALSE") + """, round(CASE WHEN part < 0 THEN part + 6 ELSE part END / 6, 9) AS hue, round(CASE WHEN t > 0 THEN whole / t ELSE 0 END, 9) AS saturation, (r // 32 % 6)::BIGINT AS shape FROM k"""
)
def sql_functions_of_colors(spark, d):
    S.register_sql_functions(spark)
    cells = views.pix(spark, d).selectExpr("x", "y", "cast(r AS int) AS r", "cast(g AS int) AS g", "cast(b AS int) AS b")
    return cells.selectExpr("x", "y", "grid_paint_green(r, g, b, cast((x + y) % 32 AS int)) AS green", "round(grid_hue(r, g, b), 9) AS hue", "round(grid_saturation(r, g, b), 9) AS saturation", "grid_recipe_part(r, 'shape') AS shape")
