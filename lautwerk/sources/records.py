"""Source files as records ``name count source origin variants``, and their union in order.

The dialect of delimited files is fixed here: no quoted delimiters, one quote taken off each end of a cell. ``row`` orders the
records of a source; it is any type that orders.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import MARKED, PLAIN, trim

RECORD = "name string, count double, source string, origin string, variants array<string>"


def delimited(spark: SparkSession, path: str) -> DataFrame:
    """``path row cells`` with ``cells`` an array by the file's ``headers``, lower case; blank lines are dropped.

    Files are read by lines, so large ones are split over tasks. ``row`` orders the lines of one read: files by name, then
    lines by place. Each file's first line that isn't blank is its header.
    """
    mark = "^\ufeff"
    lines = (
        spark.read.text(path, lineSep="\n")
        .select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"), F.regexp_replace("value", r"\r$", "").alias("line"))
        .filter(trim(F.regexp_replace("line", mark, "")) != "")
    )
    # lines of a block are numbered in order, and a file's blocks start ever later
    first = lines.groupBy("path").agg(F.min_by(F.struct("block", "n", "line"), F.struct("block", "n")).alias("head"))
    head = F.regexp_replace("head.line", mark, "")
    semicolons = F.contains(head, F.lit(";")) & ~F.contains(head, F.lit(","))
    by = F.when(semicolons, ";").otherwise(",")
    cells = lambda line, by: F.transform(F.split(line, by), lambda c: F.regexp_replace(trim(c), '^"|"$', ""))
    files = first.select("path", F.struct("head.block", "head.n").alias("at"), by.alias("by"), F.transform(cells(head, by), F.lower).alias("headers"))
    return (
        lines.join(files, "path")
        .filter(F.struct("block", "n") != F.col("at"))
        .select("path", F.struct("path", "block", "n").alias("row"), "headers", cells(F.col("line"), F.col("by")).alias("cells"))
    )


def cell(*names: str) -> Column:
    """The cell under the first of these headers that the file has, or null."""
    at = F.lit(None).cast("bigint")
    for name in reversed(names):
        place = F.array_position("headers", F.lit(name))
        at = F.when(place > 0, place).otherwise(at)
    return F.get("cells", (at - 1).cast("int"))


def _number(text: Column) -> Column:
    return text.try_cast("double")


def _finite_positive(count: Column) -> Column:
    return (count > 0) & ~F.isnan(count) & (count != float("inf"))


def country_records(spark: SparkSession, path: str, country: str, source: str) -> DataFrame:
    """Records of one country from a file with name, country_code, count and maybe origin; ``row`` orders them."""
    table = delimited(spark, path)
    first = table.select("headers").first()
    if first and not {"name", "country_code", "count"} <= set(first["headers"]):
        raise ValueError(f"{path}: name, country_code and count are needed")
    count = _number(cell("count"))
    return table.select(
        "row", cell("name").alias("name"), count.alias("count"), F.upper(cell("country_code")).alias("country"),
        F.lit(source).alias("source"), F.coalesce(cell("origin"), F.lit("")).alias("origin"),
    ).filter((F.col("country") == country) & (F.col("name") != "") & _finite_positive(F.col("count"))).select(
        "row", "name", "count", "source", "origin", F.array().cast("array<string>").alias("variants")
    )


def _summed(rows: DataFrame, source: str) -> DataFrame:
    kept = rows.filter((F.col("name") != "") & _finite_positive(F.col("count")))
    return kept.groupBy("name").agg(F.sum("count").alias("count"), F.min("row").alias("row")).select(
        "row", "name", "count", F.lit(source).alias("source"), F.lit("").alias("origin"), F.array().cast("array<string>").alias("variants")
    )


def municipal_records(spark: SparkSession, path: str, source: str) -> DataFrame:
    """Given names of a city, summed per name; a file without the columns gives none."""
    text = F.coalesce(cell("anzahl", "count"), F.lit("0"))
    count = _number(F.regexp_replace(F.regexp_replace(text, "^([^,]*),", "$1."), "^$", "0"))
    return _summed(delimited(spark, path).select("row", cell("vorname", "name").alias("name"), count.alias("count")), source)


def json_records(spark: SparkSession, path: str, source: str) -> DataFrame:
    """Given names from JSON: a list of rows, or a map from name to a count or a row; summed per name."""
    raw = spark.read.text(path, wholetext=True)
    row = "struct<vorname:string,name:string,anzahl:string,count:string>"
    listed = raw.select(F.posexplode(F.from_json("value", f"array<{row}>")).alias("row", "r")).select(
        "row", F.coalesce("r.vorname", "r.name").alias("name"), _number(F.coalesce("r.anzahl", "r.count")).alias("count")
    ).filter("name is not null")
    inner = F.from_json("v", row)
    mapped = (
        raw.filter(F.ltrim("value").startswith("{"))
        .select(F.posexplode(F.from_json("value", "map<string,string>")).alias("row", "name", "v"))
        # a bare number or a row; text in quotes is neither, though from_json takes the quotes off
        .select("row", "name", F.when(F.col("v").startswith("{"), _number(F.coalesce(inner["anzahl"], inner["count"]))).otherwise(_number(F.col("v"))).alias("count"))
    )
    return _summed(listed.unionByName(mapped), source)


def newest_csv(package: str) -> Column:
    """The URL of the CSV resource with the last name, in German order, in a CKAN package description."""
    shape = "struct<result:struct<resources:array<struct<format:string,url:string,name:string>>>>"
    resources = F.from_json(F.lit(package), shape)["result"]["resources"]
    csv = F.filter(resources, lambda r: (F.upper(r["format"]) == "CSV") & (r["url"] != ""))
    named = F.transform(csv, lambda r: F.struct(F.collate(F.coalesce(r["name"], F.lit("")), "de").alias("name"), r["url"].alias("url")))
    return F.array_max(named)["url"]


def sparql_records(results: DataFrame, source: str = "wikidata") -> DataFrame:
    """Names from SPARQL result texts (``value``, in order ``row``): empty and bare item labels are dropped; count 1."""
    shape = "struct<results:struct<bindings:array<struct<itemLabel:struct<value:string>>>>>"
    bindings = results.select("row", F.posexplode(F.from_json("value", shape)["results"]["bindings"]).alias("at", "b"))
    name = trim(F.coalesce(F.col("b.itemLabel.value"), F.lit("")))
    named = bindings.select((F.col("row") * 1_000_000 + F.col("at")).alias("row"), name.alias("name"))
    return named.filter((F.col("name") != "") & ~F.col("name").rlike(r"^Q\d+$")).select(
        "row", "name", F.lit(1.0).alias("count"), F.lit(source).alias("source"), F.lit("").alias("origin"), F.array().cast("array<string>").alias("variants")
    )


#: Umlauts as they are written without them.
WRITTEN = (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("Ä", "Ae"), ("Ö", "Oe"), ("Ü", "Ue"), ("ß", "ss"))


def with_ascii_variants(records: DataFrame) -> DataFrame:
    """Adds the spelling with umlauts written out and then without marks, where it differs from the name."""
    written = F.col("name")
    for letter, out in WRITTEN:
        written = F.replace(written, F.lit(letter), F.lit(out))
    bare = F.regexp_replace(F.translate(written, MARKED, PLAIN), r"\p{M}+", "")
    more = F.filter(F.array(bare), lambda v: v != F.col("name"))
    return records.withColumn("variants", F.array_union(F.coalesce("variants", F.array().cast("array<string>")), more))


def union(kind: str, *sources: DataFrame) -> DataFrame:
    """Sources one after the other, as records with ``kind`` and ``seq``, a struct of the source's place and the row's as text.
    ``row`` orders each source, if it has one."""
    parts = []
    for k, df in enumerate(sources):
        row = F.col("row") if "row" in df.columns else F.monotonically_increasing_id()
        if "row" in df.columns and df.schema["row"].dataType.typeName() == "struct":
            at = F.struct(F.col("row.path").alias("path"), F.col("row.block").alias("block"), F.col("row.n").alias("n"))
        else:
            at = F.struct(F.lit("").alias("path"), F.lit(0).cast("long").alias("block"), row.cast("long").alias("n"))
        parts.append(df.select(F.struct(F.lit(k).alias("source"), at.alias("at")).alias("seq"), "name", "count", "source", "origin", "variants"))
    return reduce(DataFrame.unionByName, parts).select(F.lit(kind).alias("kind"), "seq", "name", "count", "source", "origin", "variants")


def available(*readers: Callable[[], DataFrame]) -> tuple[list[DataFrame], list[str]]:
    """The sources whose readers work, in order, and what the others said: one that fails must not stop a build."""
    found, errors = [], []
    for read in readers:
        try:
            df = read()
            df.take(1)  # files are opened only now
            found.append(df)
        except (PySparkException, Py4JJavaError, ValueError, OSError) as error:
            errors.append(f"{type(error).__name__}: {str(error).splitlines()[0]}")
    return found, errors


# Seeds that are merged into every lexicon; name, count, variants.
FAMILY = (
    ("Müller", 46400, ("Mueller", "Muller")), ("Schmidt", 31905, ("Schmitt", "Schmid", "Schmit")),
    ("Schneider", 16824, ("Schnyder",)), ("Fischer", 14200, ()), ("Weber", 12100, ()),
    ("Meyer", 11000, ("Meier", "Maier", "Mayer")), ("Wagner", 10500, ()), ("Becker", 9800, ()),
    ("Schulz", 9200, ("Schultz",)), ("Hoffmann", 8800, ("Hofmann",)), ("Schäfer", 7500, ("Schaefer",)),
    ("Koch", 7200, ()), ("Bauer", 7000, ()), ("Richter", 6800, ()), ("Klein", 6500, ()), ("Wolf", 6200, ()),
    ("Schröder", 6000, ("Schroeder",)), ("Neumann", 5800, ("Neuman",)), ("Schwarz", 5600, ()),
    ("Zimmermann", 5400, ()), ("Braun", 5200, ()), ("Krüger", 5000, ("Krueger",)), ("Hofmann", 4800, ()),
    ("Hartmann", 4600, ()), ("Lange", 4400, ()), ("Yıldırım", 800, ("Yildirim", "Jildirim")),
    ("Szczepański", 400, ("Szczepanski",)), ("Nguyen", 5000, ()), ("Öztürk", 600, ("Oeztuerk", "Ozturk")),
    ("Mustermann", 1, ()), ("Bergmann", 1200, ()),
)
GIVEN = (
    ("Mia", 10000, ()), ("Jannik", 5000, ("Yannick", "Janik")), ("Yannick", 4200, ("Jannik",)),
    ("Klaus", 7000, ("Claus",)), ("Claus", 2500, ("Klaus",)), ("Noah", 12000, ()), ("Emma", 10500, ()),
    ("Sophie", 11500, ("Sofie",)),
)
ORIGINS = {"Müller": "German"}


def seeds(spark: SparkSession, kind: str) -> DataFrame:
    rows = [
        (k, name, float(count), "curated", ORIGINS.get(name, ""), list(variants))
        for k, (name, count, variants) in enumerate(FAMILY if kind == "family" else GIVEN)
    ]
    return spark.createDataFrame(rows, "row long, " + RECORD)


def seed_records(spark: SparkSession) -> DataFrame:
    """The offline records of both kinds."""
    return union("family", seeds(spark, "family")).unionByName(union("given", seeds(spark, "given")))
