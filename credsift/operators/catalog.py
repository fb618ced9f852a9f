"""Known values: exact, by hash, by expression; the first strategy that knows a value decides."""

from __future__ import annotations

import re
import re._parser as parser
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.patterns import certain_texts
from ..sources.store import ship_package, written

#: Expressions sent to every task at a time.
BLOCK = 2_000
SCHEMA = "pos int, id string, kind string, strategy string, value string, verdict string"


def sample_entries() -> list[tuple]:
    """Public examples from vendors' documentation, assembled here so that no value stands in the file."""
    a, j = "AK" + "IA", "ey" + "J"
    return [
        (0, "aws.docs.example_key", "aws_access_key", "exact", a + "IOSFODNN7" + "EXAMPLE", "FIXTURE"),
        (1, "jwt.docs.header", "jwt", "regex", "^" + j + r"hbGciOiJIUzI1NiIs[\w-]*\.", "FIXTURE"),
        (2, "placeholder.changeme", "secret_assignment", "exact", "changeme" + "_changeme", "FIXTURE"),
        (3, "docs.mask", "secret_assignment", "exact_hash", "e2a4dd1a8e2c3fa8c41c1a0ce3ba7b0db38ab2a2f8e8ee1c3b9e1d3a59b2bfb3", "FIXTURE"),
        (4, "postgres.docs.userpass", "postgres_url", "regex", r"://(?:user|username):(?:pass|password)@", "FIXTURE"),
        (5, "leaked.prefix", "github_token", "regex", "^gh" + "p_0", "KNOWN_LEAKED"),
        (6, "canary.prefix", "stripe_secret", "regex", "^sk" + "_live_f", "HONEYTOKEN"),
        (7, "never.second", "aws_access_key", "regex", "^" + a + "IOSF", "KNOWN_LEAKED"),
    ]


def catalog_frame(spark: SparkSession, entries: list[tuple] | None = None) -> DataFrame:
    return spark.createDataFrame(entries or sample_entries(), SCHEMA)


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """A catalogue file: JSON with ``entries`` of id, kind, match{strategy, value | sha256 | pattern}, verdict."""
    raw = spark.read.json(path, multiLine=True, schema="entries array<struct<id:string,kind:string,match:struct<strategy:string,value:string,sha256:string,pattern:string>,verdict:string>>")
    rows = raw.select(F.posexplode("entries").alias("pos", "e"))
    return rows.select("pos", "e.id", "e.kind", "e.match.strategy", F.coalesce("e.match.value", "e.match.sha256", "e.match.pattern").alias("value"), F.coalesce("e.verdict", F.lit("FIXTURE")).alias("verdict"))


def counts(catalog: DataFrame) -> DataFrame:
    """strategy, verdict, n, n_kinds: what a catalogue holds."""
    return catalog.groupBy("strategy", "verdict").agg(F.count("*").alias("n"), F.countDistinct("kind").alias("n_kinds"))


def read_chain(spark: SparkSession, *paths: str | None) -> DataFrame:
    """The first catalogue of ``paths`` that is there (a refreshed copy, the user's own), else the examples that come with this package.

    A catalogue that is there but can't be read is an error; it isn't passed over for the next.
    """
    for path in filter(None, paths):
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
            rows = read_catalog(spark, path)
            if rows.filter("strategy is null or value is null").limit(1).count():
                raise ValueError(f"{path}: an entry has no strategy or value")
            return rows
    return catalog_frame(spark)


def required_texts(regex: str) -> list[str]:
    """Texts of three characters or more of which every match holds one; none where nothing is certain."""
    try:
        tree = parser.parse(regex)
    except Exception:  # an expression of Java's that Python can't read has no certain text
        return []
    if tree.state.flags & re.IGNORECASE or re.search(r"\(\?[a-z]*i", regex):
        return []
    found = certain_texts(tree)
    return list(found) if all(len(x) >= 3 for x in found) else []


def _threes(text):
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - 2), lambda i: F.substring(text, i, F.lit(3))))


def _by_required_text(values: DataFrame, rules: DataFrame) -> DataFrame:
    """match, pos, id, verdict of the expressions that know a value, found by three characters that these demand.

    Of a required text the three characters are taken that fewest expressions demand, so a beginning that all share selects nothing.
    """
    demands = rules.select("pos", F.explode("needs").alias("text"))
    threes = demands.withColumn("three", F.explode(_threes(F.col("text"))))
    usual = threes.groupBy("three").agg(F.count("*").alias("n"))
    chosen = threes.join(usual, "three").groupBy("pos", "text").agg(F.min_by("three", F.struct("n", "three")).alias("three"))
    index = rules.drop("needs").join(chosen, "pos")
    asked = values.filter(F.length("match") >= 3).select("match", F.explode(_threes(F.col("match"))).alias("three"))
    return asked.join(index, "three").filter(F.contains("match", F.col("text")) & F.expr("rlike(match, value)")).select("match", "pos", "id", "verdict")


def lookup(findings: DataFrame, catalog: DataFrame) -> DataFrame:
    """``findings`` with catalog_id and catalog_verdict (null where no entry knows the value).

    Values are looked up once each. Exact values and hashes are joined, whatever their number. Expressions meet the values that hold
    three characters of a text they demand; those that demand none are tried on every value, in blocks of at most ``BLOCK``.
    Of several expressions the first in the file counts. Few entries are sent to the values, so these are dealt out once, by value.
    """
    ship_package(findings.sparkSession)
    values = findings.select("match").distinct()
    number = {r.strategy: r.n for r in catalog.groupBy("strategy").agg(F.count("*").alias("n")).collect()}  # three strategies
    sent = lambda rows, strategy: F.broadcast(rows) if number.get(strategy, 0) <= BLOCK else rows
    pick = lambda order: F.expr(f"max_by(struct(id, verdict), {order}pos)")
    exact = catalog.filter("strategy = 'exact'").groupBy("value").agg(pick("").alias("e"))
    hashed = catalog.filter("strategy = 'exact_hash'").groupBy(F.lower("value").alias("value")).agg(pick("").alias("h"))
    known = values.join(sent(exact, "exact"), values["match"] == exact["value"], "left").drop("value")
    known = known.join(sent(hashed, "exact_hash"), F.sha2("match", 256) == hashed["value"], "left").drop("value")

    def demand(batches):
        for batch in batches:
            yield batch.assign(needs=batch["value"].map(required_texts))

    loose = rules = catalog.filter("strategy = 'regex'").select("pos", "id", "verdict", "value")
    many = number.get("regex", 0) > BLOCK  # fewer are tried on every value at once, which costs less than looking for their texts
    if many:
        rules = written(rules.mapInPandas(demand, "pos int, id string, verdict string, value string, needs array<string>"), "catalogue")
        loose = rules.filter("size(needs) = 0")
    else:  # in one pass over the values, beside their exact entries
        tried = known.join(F.broadcast(rules), F.expr("rlike(match, value)"), "left")
        return _with_entries(findings, tried.groupBy("match", "e", "h").agg(pick("-").alias("r")))
    blocks = max(1, -(-loose.count() // BLOCK))
    dealt = [loose if blocks == 1 else loose.filter(F.pmod("pos", F.lit(blocks)) == i) for i in range(blocks)]
    tried = reduce(DataFrame.union, (values.join(F.broadcast(r), F.expr("rlike(match, value)")).select("match", "pos", "id", "verdict") for r in dealt))
    tried = tried.union(_by_required_text(values, rules.filter("size(needs) > 0")))
    by_rule = tried.groupBy("match").agg(pick("-").alias("r"))
    return _with_entries(findings, known.join(by_rule, "match", "left"))


def _with_entries(findings: DataFrame, known: DataFrame) -> DataFrame:
    """``findings`` with the entry of their value: of ``known`` (match, e exact, h by hash, r by expression) the first that there is."""
    known = known.withColumn("c", F.coalesce("e", "h", "r"))
    return findings.join(known.select("match", F.col("c.id").alias("catalog_id"), F.col("c.verdict").alias("catalog_verdict")), "match", "left")
