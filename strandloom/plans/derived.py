"""Genomic tables derived from the given tables, in Spark and as common table expressions for the SQL check."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S


def h(x: Column, tag: str) -> Column:
    return S.hash32(x.cast("string"), F.lit(tag))


def dna(x: Column, tag: str) -> Column:
    return F.translate(F.md5(F.concat_ws("|", x.cast("string"), F.lit(tag))), "0123456789abcdef", "ACGT" * 4)


def h_sql(x: str, tag: str) -> str:
    return f"cast('0x' || substr(md5(cast({x} as varchar) || '|{tag}'), 1, 8) as bigint)"


def dna_sql(x: str, tag: str) -> str:
    return f"translate(md5(cast({x} as varchar) || '|{tag}'), '0123456789abcdef', '{'ACGT' * 4}')"


class Derived:
    """The tables of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def loci(self) -> DataFrame:
        """One locus for each part. Joined by merging: by the small file's size it would be broadcast, but names and sequences are made here."""
        k = F.col("p_partkey")
        c = F.concat(F.lit("chr"), 1 + k % 22)
        left, right = (F.substring(F.concat(dna(k, f"{s}0"), dna(k, f"{s}1")), 1, 49) for s in "LR")
        return self.table("part").select(
            F.concat(F.lit("cg"), F.lpad(k.cast("string"), 8, "0")).alias("probe_id"), k.alias("part_key"), c.alias("chr"), (h(k, "pos") % 1_000_000).alias("pos"), S.split_of(c).alias("split"), F.concat(left, F.lit("CG"), right).alias("seq")
        ).hint("merge")

    @cached_property
    def normals(self) -> DataFrame:
        return self.table("lineitem").select(F.col("l_partkey").alias("part_key"), F.col("l_suppkey").alias("sample_id"), (F.col("l_suppkey") % 50).alias("participant"), S.nan_to_null(F.col("l_discount") * 10).alias("beta"))

    @cached_property
    def signals(self) -> DataFrame:
        start = h(F.col("event_id"), "sig") % 1_000_000
        return self.table("events").select("event_id", F.col("event_type").alias("track"), F.concat(F.lit("chr"), 1 + F.col("user_id") % 22).alias("chr"), start.alias("start"), (start + 1 + F.col("event_id") % 500).alias("end"), S.nan_to_null(F.col("value")).alias("value"))

    @cached_property
    def variants(self) -> DataFrame:
        k = F.col("o_orderkey")
        ref = F.substring(F.lit("ACGT"), (1 + k % 4).cast("int"), F.lit(1))
        return self.table("orders").select(k.alias("variant_id"), F.concat(F.lit("chr"), 1 + k % 22).alias("chr"), (1 + h(k, "var") % 1_000_000).alias("pos1"), ref.alias("ref"), F.translate(ref, "ACGT", "CGTA").alias("alt"))

    @cached_property
    def in_window(self) -> DataFrame:
        """Variants inside the sequence of a locus, on its protected pair too."""
        n = self.table("part").agg(F.count(F.lit(1)).alias("n"))
        k = F.col("o_orderkey")
        at = self.table("orders").select(k.alias("variant_id")).crossJoin(F.broadcast(n)).select("variant_id", (F.col("variant_id") % F.col("n")).alias("part_key"), (F.col("variant_id") % 100 - 49).alias("offset"))
        ref = F.substring("seq", (50 + F.col("offset")).cast("int"), F.lit(1))
        return (
            at.join(self.loci, "part_key")
            .select("variant_id", "part_key", "probe_id", "chr", "pos", "split", "offset", F.col("seq").alias("wt"), ref.alias("ref"), F.translate(ref, "ACGT", "CGTA").alias("alt"))
            .withColumn("mut", S.substitute(F.col("wt"), F.col("offset") + 49, F.col("alt")))
        )

    @cached_property
    def segments(self) -> DataFrame:
        return self.table("lineitem").select(F.col("l_orderkey").alias("tx"), F.when(F.col("l_orderkey") % 2 == 0, "+").otherwise("-").alias("strand"), F.col("l_linenumber").alias("part"), "l_partkey", "l_suppkey", "l_extendedprice", (3 + F.col("l_quantity").cast("long")).alias("len"))

    @cached_property
    def truth(self) -> DataFrame:
        return self.normals.groupBy("part_key").agg(F.median("beta").alias("truth"))

    @cached_property
    def predictions(self) -> DataFrame:
        runs = F.explode(F.array(*(F.struct(F.lit(s).alias("seed"), F.lit(m).alias("model"), F.lit(float(k)).alias("k")) for s in (42, 43, 44) for m, k in (("context", 2000), ("sequence", 4000), ("fusion", 5000)))))
        rows = self.loci.join(self.truth, "part_key").select("part_key", "probe_id", "chr", "pos", "split", "truth", runs.alias("r")).select("*", "r.*").drop("r")
        h2 = S.hash32(F.col("part_key").cast("string"), F.col("seed").cast("string"), F.col("model"))
        return rows.withColumn("pred", F.least(F.greatest(F.col("truth") + (h2 % 2001 - 1000) / F.col("k"), F.lit(0.0)), F.lit(1.0))).drop("k")

    @cached_property
    def leads(self) -> DataFrame:
        k = F.col("c_custkey")
        return self.table("customer").select(
            k.alias("lead_id"), ((h(k, "q") % 100_000) / 1e5).alias("qval"), ((h(k, "maf") % 50_000) / 1e5).alias("maf"), F.concat(F.lit("chr"), 1 + F.col("c_nationkey") % 22).alias("chr"), (F.col("c_acctbal") / 1000 - 5).alias("slope"), (h(k, "eff") % 2001 - 1000).cast("double").alias("effect"), (k % 97).alias("cluster")
        )

    @cached_property
    def scored(self) -> DataFrame:
        return self.table("labels").join(self.table("documents").select("doc_id", "n_chars"), "doc_id").select("doc_id", F.col("quality").alias("y"), F.col("n_chars").cast("double").alias("score"))


CTE = {
    "loci": f"""SELECT 'cg' || lpad(cast(p_partkey AS varchar), 8, '0') AS probe_id, p_partkey AS part_key, 'chr' || (1 + p_partkey % 22) AS chr, {h_sql("p_partkey", "pos")} % 1000000 AS pos,
        CASE WHEN 1 + p_partkey % 22 IN (8, 9) THEN 'test' WHEN 1 + p_partkey % 22 IN (10, 11) THEN 'val' ELSE 'train' END AS split,
        substr({dna_sql("p_partkey", "L0")} || {dna_sql("p_partkey", "L1")}, 1, 49) || 'CG' || substr({dna_sql("p_partkey", "R0")} || {dna_sql("p_partkey", "R1")}, 1, 49) AS seq FROM part""",
    "normals": "SELECT l_partkey AS part_key, l_suppkey AS sample_id, l_suppkey % 50 AS participant, l_discount * 10 AS beta FROM lineitem",
    "signals": f"""SELECT event_id, event_type AS track, 'chr' || (1 + user_id % 22) AS chr, {h_sql("event_id", "sig")} % 1000000 AS "start", {h_sql("event_id", "sig")} % 1000000 + 1 + event_id % 500 AS "end", value FROM events""",
    "variants": f"""SELECT o_orderkey AS variant_id, 'chr' || (1 + o_orderkey % 22) AS chr, 1 + {h_sql("o_orderkey", "var")} % 1000000 AS pos1, substr('ACGT', 1 + o_orderkey % 4, 1) AS ref, substr('CGTA', 1 + o_orderkey % 4, 1) AS alt FROM orders""",
    "in_window": """SELECT o.o_orderkey AS variant_id, l.part_key, probe_id, chr, pos, split, o_orderkey % 100 - 49 AS "offset", seq AS wt, substr(seq, cast(50 + o_orderkey % 100 - 49 AS bigint), 1) AS ref,
        translate(substr(seq, cast(50 + o_orderkey % 100 - 49 AS bigint), 1), 'ACGT', 'CGTA') AS alt,
        substr(seq, 1, cast(o_orderkey % 100 AS bigint)) || translate(substr(seq, cast(50 + o_orderkey % 100 - 49 AS bigint), 1), 'ACGT', 'CGTA') || substr(seq, cast(o_orderkey % 100 + 2 AS bigint)) AS mut
        FROM orders o JOIN loci l ON l.part_key = o.o_orderkey % (SELECT count(*) FROM part)""",
    "segments": "SELECT l_orderkey AS tx, CASE WHEN l_orderkey % 2 = 0 THEN '+' ELSE '-' END AS strand, l_linenumber AS part, l_partkey, l_suppkey, l_extendedprice, 3 + cast(l_quantity AS bigint) AS len FROM lineitem",
    "truth": "SELECT part_key, median(beta) AS truth FROM normals GROUP BY 1",
    "predictions": """SELECT part_key, probe_id, chr, pos, split, truth, seed, model, least(greatest(truth + (cast('0x' || substr(md5(part_key || '|' || seed || '|' || model), 1, 8) AS bigint) % 2001 - 1000) / k, 0.0), 1.0) AS pred
        FROM loci JOIN truth USING (part_key), (VALUES (42), (43), (44)) s(seed), (VALUES ('context', 2000.0::double), ('sequence', 4000.0::double), ('fusion', 5000.0::double)) m(model, k)""",
    "leads": f"""SELECT c_custkey AS lead_id, ({h_sql("c_custkey", "q")} % 100000) / 1e5 AS qval, ({h_sql("c_custkey", "maf")} % 50000) / 1e5 AS maf, 'chr' || (1 + c_nationkey % 22) AS chr, c_acctbal / 1000 - 5 AS slope,
        cast({h_sql("c_custkey", "eff")} % 2001 - 1000 AS double) AS effect, c_custkey % 97 AS cluster FROM customer""",
    "scored": "SELECT doc_id, quality AS y, cast(n_chars AS double) AS score FROM labels JOIN documents USING (doc_id)",
}
_NEEDS = {"in_window": ("loci",), "truth": ("normals",), "predictions": ("loci", "normals", "truth")}


def with_tables(*names: str) -> str:
    """WITH and the tables that names need, ready for more of them."""
    order = list(dict.fromkeys(x for n in names for x in (*_NEEDS.get(n, ()), n)))
    return "WITH " + ", ".join(f"{n} AS ({CTE[n]})" for n in order)
