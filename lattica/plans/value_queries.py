"""Queries over values: numbers, strings, enums, structs, sequences, checksums and low-precision floats."""

from __future__ import annotations

from pyspark.sql import functions as F

from lattica.functions import codecs, lowfloat, strings
from lattica.operators import catalog, compound

from .registry import query
from .tables import E_SQL, embeddings, table

STATUS = {"O": 0, "F": 1, "P": 2}
SOURCES = "CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'F' THEN 1 WHEN 'P' THEN 2 END"


@query("SELECT p_partkey, CAST(p_size AS DOUBLE) AS as_int, CAST(p_size % 128 AS DOUBLE) AS as_byte, CAST(-p_size AS DOUBLE) AS negative, CAST(p_retailprice AS DOUBLE) AS as_float FROM part")
def int_widening(spark, sf_dir):
    s = F.col("p_size")
    return table(spark, sf_dir, "part").select("p_partkey", s.cast("double").alias("as_int"), (s % 128).cast("tinyint").cast("double").alias("as_byte"), (-s).cast("smallint").cast("double").alias("negative"), F.col("p_retailprice").cast("double").alias("as_float"))


@query("SELECT p_partkey, CAST(9007199254740992 + p_partkey AS DOUBLE) AS wide, 9007199254740992 + p_partkey - CAST(CAST(9007199254740992 + p_partkey AS DOUBLE) AS BIGINT) AS lost FROM part")
def u64_precision(spark, sf_dir):
    """What 64-bit integers over 2^53 lose as doubles."""
    x = F.lit(1 << 53) + F.col("p_partkey")
    return table(spark, sf_dir, "part").select("p_partkey", x.cast("double").alias("wide"), (x - x.cast("double").cast("long")).alias("lost"))


@query("SELECT p_partkey AS id, p_size AS count, p_retailprice AS x, CAST(p_size * 2 AS DOUBLE) AS y, p_brand AS label FROM part WHERE p_size > 10")
def compound_nested(spark, sf_dir):
    """Structs in structs, and their members again."""
    part = table(spark, sf_dir, "part")
    v = compound.pack(id=F.col("p_partkey"), point=compound.pack(x=F.col("p_retailprice"), y=(F.col("p_size") * 2).cast("double")), count=F.col("p_size"), label=F.col("p_brand"))
    packed = part.select(v.alias("value"))
    return packed.where("value.count > 10").select("value.id", "value.count", "value.point.x", "value.point.y", "value.label")


@query("SELECT o_custkey, count(*) AS n, max(o_totalprice) AS most FROM orders WHERE o_orderstatus = 'O' GROUP BY 1")
def compound_project(spark, sf_dir):
    """One member of a struct is read, not all."""
    orders = table(spark, sf_dir, "orders").select(compound.pack(key=F.col("o_orderkey"), cust=F.col("o_custkey"), status=F.col("o_orderstatus"), price=F.col("o_totalprice")).alias("v"))
    return orders.where("v.status = 'O'").groupBy(F.col("v.cust").alias("o_custkey")).agg(F.count("*").alias("n"), F.max("v.price").alias("most"))


@query(r"""SELECT p_partkey, split_part(p_name, ' ', 1) AS terminated, p_name AS null_padded, p_name AS space_padded, p_name AS member FROM part""")
def fixed_string_decode(spark, sf_dir):
    """The three paddings, and that of members."""
    n, nul = F.col("p_name"), F.lit("\u0000")
    raw = [F.replace(n, F.lit(" "), nul), F.concat(n, nul, nul), F.concat(n, F.lit("   ")), F.concat(n, F.lit("  "), nul)]
    return table(spark, sf_dir, "part").select(
        "p_partkey", strings.decode_fixed(raw[0], 0).alias("terminated"), strings.decode_fixed(raw[1], 1).alias("null_padded"), strings.decode_fixed(raw[2], 2).alias("space_padded"), strings.decode_member(raw[3], 2).alias("member")
    )


@query(r"""SELECT p_partkey, rpad(lower(hex(encode(substr(p_name, 1, 12)))), 24, '0') AS raw, least(length(p_name), 12) AS kept FROM part""")
def fixed_string_encode(spark, sf_dir):
    """Cut to or padded to 12 bytes."""
    raw = strings.encode_fixed(F.col("p_name"), 12)
    return table(spark, sf_dir, "part").select("p_partkey", F.lower(F.hex(raw)).alias("raw"), F.least(F.length("p_name"), F.lit(12)).cast("long").alias("kept"))


@query(f"SELECT {SOURCES} AS code, count(*) AS n FROM orders GROUP BY 1")
def enum_encode(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(compound.enum_code(F.col("o_orderstatus"), STATUS).alias("code")).agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'O' WHEN 1 THEN 'F' WHEN 2 THEN 'P' END AS name FROM orders")
def enum_decode(spark, sf_dir):
    """Codes without a name are null."""
    return table(spark, sf_dir, "orders").select("o_orderkey", compound.enum_name((F.col("o_orderkey") % 4).cast("int"), STATUS).alias("name"))


@query("""WITH v AS (SELECT l_orderkey, list(l_quantity ORDER BY l_linenumber, l_quantity) AS values FROM lineitem GROUP BY 1)
SELECT l_orderkey, len(values)::BIGINT AS n, values[1] AS first, values[len(values)] AS last, list_sum(values) AS total FROM v""")
def vlen_ragged(spark, sf_dir):
    """A sequence for each order, of any length."""
    v = compound.ragged(table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_quantity", ["l_linenumber"])
    return v.select("l_orderkey", F.size("values").cast("long").alias("n"), F.element_at("values", 1).alias("first"), F.element_at("values", -1).alias("last"), F.aggregate("values", F.lit(0.0), lambda a, x: a + x).alias("total"))


@query("SELECT l_linenumber, count(*) AS n, sum(l_quantity) AS total FROM lineitem GROUP BY 1")
def vlen_flatten(spark, sf_dir):
    """Sequences taken apart again."""
    pairs = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct("l_linenumber", "l_quantity")).alias("v"))
    return pairs.select(F.explode("v").alias("x")).groupBy(F.col("x.l_linenumber").alias("l_linenumber")).agg(F.count("*").alias("n"), F.sum("x.l_quantity").alias("total"))


@query("SELECT p_partkey, len(string_split(p_name, ' '))::BIGINT AS words, length(p_name)::BIGINT AS chars, string_split(p_name, ' ')[1] AS first FROM part")
def vlen_strings(spark, sf_dir):
    w = F.split("p_name", " ")
    return table(spark, sf_dir, "part").select("p_partkey", F.size(w).cast("long").alias("words"), F.length("p_name").cast("long").alias("chars"), F.element_at(w, 1).alias("first"))


@query("""WITH p AS (SELECT p_partkey, '/' || p_brand || '/' || p_type || '/' || p_partkey AS path FROM part)
SELECT path, regexp_extract(path, '^(.*)/[^/]*$', 1) AS parent, CAST(p_partkey AS VARCHAR) AS name, true AS valid, false AS bad_double, false AS bad_end FROM p""")
def path_split(spark, sf_dir):
    path = F.concat_ws("/", F.lit(""), "p_brand", "p_type", "p_partkey")
    p = table(spark, sf_dir, "part").select(path.alias("path"))
    ok = strings.valid_object_path
    return p.select("path", strings.parent_path(F.col("path")).alias("parent"), strings.base_name(F.col("path")).alias("name"), ok(F.col("path")).alias("valid"), ok(F.concat(F.lit("/"), "path")).alias("bad_double"), ok(F.concat("path", F.lit("/"))).alias("bad_end"))


@query("""SELECT p_partkey, true AS soft, p_size % 3 <> 0 AS external FROM part""")
def link_target_checks(spark, sf_dir):
    """Soft targets may dangle; external files may not go up."""
    file = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("../"), "p_brand")).otherwise(F.concat("p_brand", F.lit("..h5")))
    return table(spark, sf_dir, "part").select("p_partkey", strings.valid_soft_target(F.col("p_name")).alias("soft"), strings.valid_external_file(file).alias("external"))


@query("""SELECT o_orderkey, CASE WHEN b >= 1073741824 THEN printf('%.2f GB', b / 1073741824) WHEN b >= 1048576 THEN printf('%.1f MB', b / 1048576)
WHEN b >= 1024 THEN printf('%.1f KB', b / 1024) ELSE printf('%d B', b) END AS shown FROM (SELECT o_orderkey, o_orderkey * o_orderkey * 128 AS b FROM orders)""")
def format_sizes(spark, sf_dir):
    b = F.col("o_orderkey") * F.col("o_orderkey") * 128
    return table(spark, sf_dir, "orders").select("o_orderkey", strings.format_bytes(b).alias("shown"))


@query("SELECT n_nationkey, 'Dataset: float (size=8 bytes), 2D array [' || (n_nationkey + 1) || ' x 64]' AS info, 'Dataset: integer (size=4 bytes), scalar' AS scalar FROM nation")
def dataset_infos(spark, sf_dir):
    two = F.array(F.col("n_nationkey").cast("long") + 1, F.lit(64).cast("long"))
    return table(spark, sf_dir, "nation").select("n_nationkey", strings.dataset_info(F.lit("float"), F.lit(8), two).alias("info"), strings.dataset_info(F.lit("integer"), F.lit(4), F.array().cast("array<bigint>")).alias("scalar"))


@query(r"""WITH b AS (SELECT p_partkey, p_name, unnest(range(0, (length(p_name) + 15) // 16)) AS k FROM part)
SELECT p_partkey, k * 16 AS at, lower(hex(encode(substr(p_name, k * 16 + 1, 16)))) AS hex, substr(p_name, k * 16 + 1, 16) AS ascii FROM b""")
def hex_dump(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.explode(strings.hex_rows(F.col("p_name").cast("binary"))).alias("r"))
    return p.select("p_partkey", "r.at", "r.hex", "r.ascii")


@query(r"""WITH w AS (SELECT p_partkey, length(p_name) AS n, unnest(range(0, (length(p_name) + 1) // 2)) AS k, p_name FROM part),
v AS (SELECT p_partkey, (n + 1) // 2 AS m, k, ascii(substr(p_name, 2 * k + 1, 1)) * 256 + CASE WHEN 2 * k + 2 <= n THEN ascii(substr(p_name, 2 * k + 2, 1)) ELSE 0 END AS word FROM w),
s AS (SELECT p_partkey, sum(word) % 65535 AS a, sum((m - k) * word) % 65535 AS b FROM v GROUP BY 1)
SELECT p_partkey, CAST((CASE WHEN b = 0 THEN 65535 ELSE b END) * 65536 + CASE WHEN a = 0 THEN 65535 ELSE a END AS BIGINT) AS checksum FROM s""")
def fletcher32(spark, sf_dir):
    """The chunk checksum inside the JVM."""
    return table(spark, sf_dir, "part").select("p_partkey", codecs.fletcher32_expr(F.col("p_name").cast("binary")).alias("checksum"))


@query("SELECT p_partkey, true AS same, length(p_name)::BIGINT * 4 AS n FROM part")
def codec_round_trip(spark, sf_dir):
    """Shuffle, deflate and checksum, there and back over Arrow batches."""
    data = F.repeat("p_name", 4).cast("binary")
    pipe = [(codecs.SHUFFLE, (4,)), (codecs.DEFLATE, (6,)), (codecs.FLETCHER32, ())]
    lzf = [(codecs.LZF, ())]
    x = table(spark, sf_dir, "part").select("p_partkey", data.alias("d"))
    back = (codecs.decoded(codecs.encoded(F.col("d"), pipe), pipe) == F.col("d")) & (codecs.decoded(codecs.encoded(F.col("d"), lzf), lzf) == F.col("d"))
    return x.select("p_partkey", back.alias("same"), F.octet_length("d").cast("long").alias("n"))


def _lookup3_sql(source: str) -> str:
    """SQL of the hash of the bytes of names of up to 24: steps over three words a, b, c, each a CTE. source: rows (name)."""
    m = 0xFFFFFFFF
    rot = lambda x, k: f"((({x} << {k}) | ({x} >> {32 - k})) & {m})"
    less = lambda x, y: f"(({x} - {y} + {m + 1}) & {m})"
    more = lambda x, y: f"(({x} + {y}) & {m})"
    word = lambda at: " + ".join(f"(CASE WHEN {at + k} <= n THEN ascii(substr(name, {at + k}, 1)) ELSE 0 END)::BIGINT * {1 << 8 * (k - 1)}" for k in range(1, 5))
    steps = [f"s0 AS (SELECT name, n, (({0xDEADBEEF} + n) & {m})::BIGINT AS a, (({0xDEADBEEF} + n) & {m})::BIGINT AS b, (({0xDEADBEEF} + n) & {m})::BIGINT AS c FROM (SELECT DISTINCT name, length(name) AS n FROM ({source})))"]

    def step(a: str, b: str, c: str) -> None:
        k = len(steps)
        steps.append(f"s{k} AS (SELECT name, n, {a} AS a, {b} AS b, {c} AS c FROM s{k - 1})")

    # The first twelve bytes of longer names.
    only = lambda x, old: f"CASE WHEN n > 12 THEN {x} ELSE {old} END"
    step(*[only(more(v, f"({word(4 * k)})"), v) for k, v in enumerate("abc")])
    for x, y, k, z in (("a", "c", 4, "b"), ("b", "a", 6, "c"), ("c", "b", 8, "a"), ("a", "c", 16, "b"), ("b", "a", 19, "c"), ("c", "b", 4, "a")):
        new = {x: f"xor({less(x, y)}, {rot(y, k)})", y: more(y, z), z: z}
        step(*[only(new[v], v) for v in "abc"])
    rest = lambda k: f"CASE WHEN n > 12 THEN {word(12 + 4 * k)} ELSE {word(4 * k)} END"
    step(*[more(v, f"({rest(k)})") for k, v in enumerate("abc")])
    for x, y, k in (("c", "b", 14), ("a", "c", 11), ("b", "a", 25), ("c", "b", 16), ("a", "c", 4), ("b", "a", 14), ("c", "b", 24)):
        new = {v: v for v in "abc"} | {x: less(f"xor({x}, {y})", rot(y, k))}
        step(*[new[v] for v in "abc"])
    return f"WITH {', '.join(steps)} SELECT name, c AS hash FROM s{len(steps) - 1}"


def _hashed_parts(spark, sf_dir):
    names = table(spark, sf_dir, "part").select(F.substring("p_name", 1, 20).alias("name")).distinct()
    return names.select("name", codecs.lookup3_of(F.col("name").cast("binary")).alias("hash"))


@query(f"SELECT name, hash, row_number() OVER (PARTITION BY hash % 8 ORDER BY hash, name) AS place FROM ({_lookup3_sql('SELECT substr(p_name, 1, 20) AS name FROM part')})")
def name_index_order(spark, sf_dir):
    """The places of names in eight indexes, ordered by hash."""
    return catalog.index_order(_hashed_parts(spark, sf_dir).withColumn("part", F.col("hash") % 8), "hash", "name", "part").drop("part")


@query(f"SELECT name, hash FROM ({_lookup3_sql('SELECT substr(p_name, 1, 20) AS name FROM part')})")
def name_index_lookup(spark, sf_dir):
    """Names found by hash and name; one that shares no hash is not there."""
    index = _hashed_parts(spark, sf_dir)
    wanted = index.union(spark.range(1).select(F.lit("no such name"), codecs.lookup3_of(F.lit("no such name").cast("binary"))))
    return catalog.index_lookup(index, wanted)


@query(f"SELECT n_name, hash FROM nation JOIN ({_lookup3_sql('SELECT n_name AS name FROM nation')}) ON n_name = name")
def name_hash(spark, sf_dir):
    """The 32-bit hash by which indexes order names."""
    return table(spark, sf_dir, "nation").select("n_name", codecs.lookup3_of(F.col("n_name").cast("binary")).alias("hash"))


#: The exponent of each value's leading bit, exactly, and at least a format's smallest; the value's size and sign.
_BITS = """{e}, p AS (SELECT i0, i1, CAST(value AS DOUBLE) AS v, abs(CAST(value AS DOUBLE)) AS x FROM e),
q AS (SELECT *, CASE WHEN x = 0 THEN -1000 ELSE floor(log2(x)) END AS guess FROM p),
r AS (SELECT *, guess + CASE WHEN x > 0 AND x >= pow(2.0, guess + 1) THEN 1 WHEN x > 0 AND x < pow(2.0, guess) THEN -1 ELSE 0 END AS exact FROM q)"""


@query(_BITS.format(e=E_SQL) + """, s AS (SELECT *, greatest(exact, -126) AS e FROM r), t AS (SELECT *, round_even(x / pow(2.0, e - 7), 0) AS m FROM s)
SELECT i0, i1, CAST(CASE WHEN v < 0 THEN 32768 ELSE 0 END + CASE WHEN m < 128 THEN m ELSE (e + 127) * 128 + m - 128 END AS INTEGER) AS code,
  CAST(CASE WHEN v < 0 THEN -1 ELSE 1 END * m * pow(2.0, e - 7) AS FLOAT) AS value FROM t""")
def bf16_round_trip(spark, sf_dir):
    """Values through 16 bits, of which eight are the exponent's."""
    e = embeddings(spark, sf_dir)
    return e.select("i0", "i1", lowfloat.bf16_code(F.col("value")).alias("code")).withColumn("value", lowfloat.bf16_value(F.col("code")))


@query("""WITH c AS (SELECT x AS code, (x >> 3) & 15 AS e, x & 7 AS m, CASE WHEN x >= 128 THEN -1.0 ELSE 1.0 END AS s FROM generate_series(0, 255) AS g(x)),
v AS (SELECT code, s * CASE WHEN e = 0 THEN m / 8.0 * pow(2.0, -6) ELSE (1 + m / 8.0) * pow(2.0, e - 7) END AS value FROM c WHERE e < 15)
SELECT code, CAST(value AS FLOAT) AS value FROM v""")
def f8_decode_table(spark, sf_dir):
    """Finite values of the 8-bit codes with four exponent bits."""
    codes = spark.range(256).select(F.col("id").alias("code"), lowfloat.f8_value(F.col("id"), lowfloat.E4M3).alias("value"))
    return codes.where(~F.isnan("value") & (F.abs("value") < F.lit(float("inf"))))


@query(_BITS.format(e=E_SQL) + """, s AS (SELECT *, greatest(exact, -6) AS a, greatest(exact, -14) AS b FROM r)
SELECT i0, i1, CAST(CASE WHEN v < 0 THEN -1 ELSE 1 END * least(round_even(x / pow(2.0, a - 3), 0) * pow(2.0, a - 3), 448) AS FLOAT) AS e4m3,
  CAST(CASE WHEN v < 0 THEN -1 ELSE 1 END * CASE WHEN x >= 61440 THEN 'Infinity'::DOUBLE ELSE round_even(x / pow(2.0, b - 2), 0) * pow(2.0, b - 2) END AS FLOAT) AS e5m2 FROM s""")
def f8_round_trip(spark, sf_dir):
    """Values through both 8-bit formats."""
    e = embeddings(spark, sf_dir).select("i0", "i1", "value")
    e = e.withColumn("a", lowfloat.f8_code(F.col("value"), lowfloat.E4M3)).withColumn("b", lowfloat.f8_code(F.col("value"), lowfloat.E5M2))
    return e.select("i0", "i1", lowfloat.f8_value(F.col("a"), lowfloat.E4M3, "ocp").alias("e4m3"), lowfloat.f8_value(F.col("b"), lowfloat.E5M2, "ocp").alias("e5m2"))
