"""A store's files: Markdown atoms with a front matter, JSON-line logs and triples, blobs, sealed texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .schema import EVENT, TRIPLE

FENCE = r"(?s)\A\x{FEFF}?---\r?\n(.*?)\r?\n---\r?\n?(.*)\z"


def _scalar(header: Column, name: str) -> Column:
    """A `name: value` line's value, without quotes; null if there is none or it says null."""
    value = F.regexp_extract(header, rf"(?m)^{name}:[ \t]*[\"']?([^\"'\r\n]*?)[\"']?[ \t]*$", 1)
    return F.when(value.isin("", "null", "~"), F.lit(None)).otherwise(value)


def _items(header: Column, name: str) -> Column:
    """A list in flow form ([a, b]) or in block form (- a)."""
    flow = F.regexp_extract(header, rf"(?m)^[ \t]*{name}:[ \t]*\[([^\]]*)\]", 1)
    block = F.regexp_extract(header, rf"(?m)^[ \t]*{name}:[ \t]*\r?\n((?:[ \t]*-[ \t]+.*(?:\r?\n|\z))+)", 1)
    parts = F.when(flow != "", F.split(flow, ",")).otherwise(F.regexp_extract_all(block, F.lit(r"(?m)-[ \t]+(.*)$"), F.lit(1)))
    return F.filter(F.transform(parts, lambda x: F.regexp_replace(F.trim(x), "^[\"']|[\"']$", "")), lambda x: x != "")


def read_atoms(spark: SparkSession, *folders: str) -> DataFrame:
    """Atoms of Markdown files; files without id, type and status are left out.

    Text before and after exact `---` fences is header and body; without fences, all is body (and so no atom).
    """
    files = spark.read.option("pathGlobFilter", "*.md").text(list(folders), wholetext=True)
    return parse_atoms(files.select(F.col("_metadata.file_path").alias("path"), "value"))


def parse_atoms(files: DataFrame) -> DataFrame:
    """Atoms of (path, value): file texts."""
    cut = files.select("path", F.regexp_extract("value", FENCE, 1).alias("h"), F.regexp_extract("value", FENCE, 2).alias("body"))
    h = F.col("h")
    rows = cut.select(
        "path", _scalar(h, "id").alias("atom_id"), _scalar(h, "type").alias("type"), _scalar(h, "status").alias("status"),
        _scalar(h, "confidence").try_cast("double").alias("confidence"),
        _scalar(h, "created_at").try_cast("timestamp").alias("created_at"), _scalar(h, "updated_at").try_cast("timestamp").alias("updated_at"),
        _scalar(h, "ttl_days").try_cast("int").alias("ttl_days"), _scalar(h, "classification").alias("classification"),
        F.array_sort(F.array_distinct(_items(h, "tags"))).alias("tags"), _items(h, "paths").alias("paths"), "body",
    )
    return rows.where("atom_id is not null and type is not null and status is not null")


def atom_text() -> Column:
    """An atom row as file text, keys in fixed order."""
    line = lambda k, c: F.concat(F.lit(f"{k}: "), F.coalesce(c.cast("string"), F.lit("null")))
    when = lambda k: F.date_format(k, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    listed = lambda k: F.concat(F.lit(f"{k}: ["), F.array_join(k, ", "), F.lit("]"))
    head = F.concat_ws("\n", line("id", F.col("atom_id")), *[line(k, F.col(k)) for k in ("type", "status", "confidence")], *[line(k, when(k)) for k in ("created_at", "updated_at")], *[line(k, F.col(k)) for k in ("classification", "ttl_days")], listed("tags"), listed("paths"))
    return F.concat(F.lit("---\n"), head, F.lit("\n---\n"), F.col("body"))


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """An event log of JSON lines; lines that do not parse are dropped."""
    return spark.read.schema(EVENT).option("mode", "DROPMALFORMED").json(path).where("event_id is not null")


def append_log(events: DataFrame, path: str) -> None:
    events.write.mode("append").json(path)


def read_triples(spark: SparkSession, path: str) -> DataFrame:
    """Triples, trimmed and lower-cased; rows with an empty part are skipped, confidence defaults to 1."""
    rows = spark.read.schema(TRIPLE).option("mode", "DROPMALFORMED").json(path)
    part = lambda c: F.lower(F.trim(c)).alias(c)
    rows = rows.select("atom_id", part("subject"), part("predicate"), part("object"), F.coalesce("confidence", F.lit(1.0)).alias("confidence"), "created_at")
    return rows.where("subject <> '' and predicate <> '' and object <> ''")


def blobs(rows: DataFrame, column: str) -> DataFrame:
    """(hash, data): each content once."""
    return rows.select(F.sha2(F.col(column).cast("binary"), 256).alias("hash"), F.col(column).cast("binary").alias("data")).dropDuplicates(["hash"])


def seal(text: Column, key: Column) -> Column:
    """Text, encrypted with AES-GCM under a 32-byte key, base64."""
    return F.base64(F.aes_encrypt(text, key, F.lit("GCM")))


def unseal(sealed: Column, key: Column) -> Column:
    """The text, or null if key or content are wrong."""
    return F.try_aes_decrypt(F.unbase64(sealed), key, F.lit("GCM")).cast("string")
