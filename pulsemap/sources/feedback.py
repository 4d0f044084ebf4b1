"""Loading messy exports: format and encoding detection, column aliases, dates, required columns."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ranking import numbered
from ..functions.shared import saved
from . import csvscan

# The column names that exports use, first match first.
ALIASES = {
    "text": ("text", "review text", "body", "comment", "message", "description", "review", "content", "feedback", "verbatim", "yorum", "metin", "mesaj", "açıklama", "aciklama", "şikayet", "sikayet", "şikayet metni", "talep açıklaması", "yorum metni"),
    "created_at": ("created_at", "review submit date and time", "review last update date and time", "created", "created at", "created date", "creation date", "date", "timestamp", "submitted_at", "time", "tarih", "oluşturma tarihi", "olusturma tarihi", "kayıt tarihi", "kayit tarihi", "yorum tarihi"),
    "feedback_id": ("feedback_id", "id", "ticket_id", "ticket id", "review_id", "response_id", "talep no", "talep numarası", "kayıt no", "kayit no"),
    "account_id": ("account_id", "customer_id", "customer id", "company_id", "org_id", "user_id", "user id", "kullanıcı id", "kullanici_id", "müşteri no", "musteri no"),
    "channel": ("channel", "source", "origin", "kanal", "kaynak"),
    "rating": ("rating", "star rating", "score", "stars", "nps", "puan", "yıldız", "yildiz", "memnuniyet puanı"),
    "mrr": ("mrr", "monthly_revenue", "revenue", "gelir", "aylık gelir"),
    "date": ("date", "released_at", "release_date", "shipped_at", "tarih", "yayın tarihi"),
    "title": ("title", "name", "summary", "başlık", "baslik", "sürüm adı"),
    "description": ("description", "notes", "release notes", "açıklama", "aciklama", "sürüm notları"),
}
SUBJECTS = ("subject", "review title", "konu", "başlık", "baslik")
FEEDBACK = ("text", "created_at", "feedback_id", "account_id", "channel", "rating")
PEEK = 64 << 10


class SchemaError(ValueError):
    pass


def _key(name: str) -> str:
    return name.replace("İ", "i").replace("I", "i").lower().strip()


def resolve(df: DataFrame, wanted: tuple[str, ...]) -> DataFrame:
    """df with the wanted columns renamed from their first alias present; a column serves once."""
    have, used = {_key(c): c for c in df.columns}, {}
    for name in wanted:
        if name not in df.columns:
            found = next((have[a] for a in ALIASES.get(name, ()) if a in have and have[a] not in used), None)
            if found is not None:
                used[found] = name
    return df.withColumnsRenamed(used)


def peek(spark: SparkSession, path: str, n: int = PEEK) -> bytes:
    """A file's first bytes, through Hadoop's file systems, so any store that Spark reads will do."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    stream = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(at)
    try:
        return bytes(stream.readNBytes(n))
    finally:
        stream.close()


def _cp1254() -> tuple[str, str]:
    """Characters of Latin-1, and what their bytes are in Windows-1254 where the two differ."""
    pairs = [(bytes([b]).decode("latin-1"), bytes([b]).decode("cp1254", "ignore")) for b in range(128, 256)]
    old, new = ("".join(x) for x in zip(*[(a, b) for a, b in pairs if b and a != b], strict=True))
    return old, new


def source_place() -> Column:
    """Where a row of a file lies: file, first byte of the range, place in the range."""
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("seq"))


def read_csv(spark: SparkSession, path: str, place: str | None = None) -> DataFrame:
    """All columns as strings. UTF-16 and UTF-8 by their marks, else UTF-8 if valid throughout, else Windows-1254, else Latin-1.

    Ranges of the file are read by tasks of their own, quoted line breaks or not; UTF-16, whose line ends the text source doesn't know, is one task. ``place`` names a column for source_place().
    """
    head = peek(spark, path)
    wide = head[:2] in (b"\xff\xfe", b"\xfe\xff")
    line = head.decode("utf-16" if wide else "utf-8-sig" if head.startswith(csvscan.BOM) else "latin-1", "ignore")
    line_end = "\n" if "\n" in line or "\r" not in line else "\r"
    line = line.split(line_end)[0]
    sep = max(",;\t|", key=lambda c: (line.count(c), -",;\t|".index(c)))
    options = {"header": True, "sep": sep, "multiLine": True, "escape": '"'}
    if wide:
        df = spark.read.options(encoding="UTF-16", **options).csv(path)
        return df.withColumn(place, source_place()) if place else df
    found = csvscan.scan(spark, path, sep, line_end)
    names = spark.read.options(encoding="UTF-8" if found.valid else "ISO-8859-1", **options).csv(path).columns
    text = F.col("rec").cast("string") if found.valid else F.decode("rec", "ISO-8859-1")
    if not found.valid and not found.undefined:
        old, new = _cp1254()
        text, names = F.translate(text, old, new), [c.translate(str.maketrans(old, new)) for c in names]
    text = F.regexp_replace(text, "\r$", "") if line.endswith("\r") else text
    rows = found.records.filter("block != 0 or seq != 0").select(text.alias("_rec"), F.struct("file", "block", "seq").alias("_place"))
    return rows.select(*csvscan.fields(F.col("_rec"), names, sep), *([F.col("_place").alias(place)] if place else []))


def read_table(source: str | DataFrame, spark: SparkSession | None = None, place: str | None = None) -> DataFrame:
    """A DataFrame as it is, or a file by its suffix. ``place`` names a column for where each row lies in its source; of a DataFrame, in its partitions."""
    if isinstance(source, DataFrame):
        return source.withColumn(place, F.monotonically_increasing_id()) if place else source
    spark = spark or SparkSession.getActiveSession()
    suffix = source.rsplit(".", 1)[-1].lower()
    if suffix in ("xlsx", "xls"):
        raise SchemaError("Excel files need a reader that is not installed; export the sheet as CSV")
    if suffix not in ("json", "jsonl", "parquet", "orc"):
        return read_csv(spark, source, place)
    df = spark.read.option("multiLine", suffix == "json").json(source) if suffix.startswith("json") else spark.read.format(suffix).load(source)
    return df.withColumn(place, source_place()) if place else df


NUMERIC = r"^\s*(\d{1,2})([./-])(\d{1,2})\2(\d{2,4})"


def day_first(df: DataFrame, column: str) -> bool:
    """Whether most values are numeric dates whose first part is the day; one aggregate row."""
    c = F.col(column).cast("string")
    first, second = (F.expr(f"try_cast(regexp_extract({column}, r'{NUMERIC}', {g}) as int)") for g in (1, 3))
    hit = F.regexp_extract(c, NUMERIC, 2)
    got = df.agg(F.count(c).alias("n"), F.count(F.when(hit != "", 1)).alias("m"), F.max(first).alias("a"), F.max(second).alias("b"), F.count(F.when((hit != "") & (hit != "/"), 1)).alias("other")).first()
    if not got["n"] or got["m"] <= got["n"] / 2:
        return False
    if (got["a"] or 0) > 12:
        return True
    if (got["b"] or 0) > 12:
        return False
    return got["other"] > got["m"] / 2


def parse_dates(df: DataFrame, column: str) -> Column:
    """Timestamps without a zone, in UTC where the text gives one; null where nothing fits."""
    if dict(df.dtypes)[column] in ("timestamp", "timestamp_ntz", "date"):
        return F.col(column).cast("timestamp_ntz")
    order = ("d", "M") if day_first(df, column) else ("M", "d")
    forms = [f"{a}{s}{b}{s}yyyy{t}" for s in "./-" for a, b in (order, order[::-1]) for t in ("", " H:mm", " H:mm:ss")]
    text = F.trim(F.col(column).cast("string"))
    zoned = F.when(text.rlike(r"\d{4}-\d{2}-\d{2}[T ].*(?:Z|[+-]\d{2}:?\d{2})$"), F.to_utc_timestamp(F.expr(f"try_cast(trim(cast({column} as string)) as timestamp)"), F.current_timezone()).cast("timestamp_ntz"))
    plain = F.expr(f"try_cast(trim(cast({column} as string)) as timestamp_ntz)")
    return F.coalesce(zoned, plain, *[F.try_to_timestamp(text, F.lit(f)).cast("timestamp_ntz") for f in forms])


def with_subject(df: DataFrame) -> Column:
    """The text, after its title where the body does not begin with it; null if both are empty."""
    subject = next((c for c in df.columns if _key(c) in SUBJECTS), None)
    body = F.trim(F.coalesce(F.col("text").cast("string"), F.lit("")))
    if subject is None:
        return F.nullif(body, F.lit(""))
    title = F.trim(F.coalesce(F.col(f"`{subject}`").cast("string"), F.lit("")))
    plain = F.when((title == "") | F.startswith(F.lower(body), F.lower(title)), body).when(body == "", title).otherwise(F.concat(F.regexp_replace(title, r"\.+$", ""), F.lit(". "), body))
    return F.nullif(plain, F.lit(""))


def load_feedback(source: str | DataFrame, spark: SparkSession | None = None) -> DataFrame:
    """Rows with text and a date, typed, with defaults, and ``doc_id`` in order of time, then of the source."""
    df = resolve(read_table(source, spark, "_at"), FEEDBACK)
    if missing := [c for c in ("text", "created_at") if c not in df.columns]:
        raise SchemaError(f"missing columns: {', '.join(missing)}; found: {', '.join(c for c in df.columns if c != '_at')}")
    df = df.withColumns({"text": with_subject(df), "created_at": parse_dates(df, "created_at")}).filter("text is not null and created_at is not null")
    df = saved(df, "loaded")
    if df.isEmpty():
        raise SchemaError("no rows with text and a date")
    if "feedback_id" not in df.columns:
        df = saved(numbered(df, [], [F.col("_at")], "_row").withColumn("feedback_id", F.format_string("FB-%05d", F.col("_row") + 1)).drop("_row"), "loaded")
    df = numbered(df, [], [F.col("created_at"), F.col("_at")], "doc_id").drop("_at")
    df = df.withColumn("feedback_id", F.col("feedback_id").cast("string"))
    df = df.withColumn("account_id", F.col("account_id").cast("string") if "account_id" in df.columns else F.col("feedback_id"))
    df = df.withColumn("channel", F.col("channel").cast("string") if "channel" in df.columns else F.lit("unknown"))
    return df.withColumn("rating", F.expr("try_cast(rating as double)") if "rating" in df.columns else F.lit(None).cast("double"))


def keep_first(df: DataFrame, key: str, place: str) -> DataFrame:
    """The first row of each key, by place, without the place. Partial aggregation keeps a frequent key from one task."""
    rows = df.groupBy(F.col(key).alias("_key")).agg(F.min_by(F.struct(*df.columns), place).alias("_row"))
    return rows.select("_row.*").drop(place)


def load_accounts(source: str | DataFrame, spark: SparkSession | None = None) -> DataFrame:
    df = resolve(read_table(source, spark, "_at"), ("account_id", "mrr"))
    if missing := [c for c in ("account_id", "mrr") if c not in df.columns]:
        raise SchemaError(f"missing columns: {', '.join(missing)}")
    df = df.withColumns({"account_id": F.col("account_id").cast("string"), "mrr": F.coalesce(F.expr("try_cast(mrr as double)"), F.lit(0.0))})
    return keep_first(df if "plan" in df.columns else df.withColumn("plan", F.lit("unknown")), "account_id", "_at")


def load_releases(source: str | DataFrame, spark: SparkSession | None = None) -> DataFrame:
    df = resolve(read_table(source, spark), ("date", "title", "description"))
    if missing := [c for c in ("date", "title") if c not in df.columns]:
        raise SchemaError(f"missing columns: {', '.join(missing)}")
    df = df.withColumn("date", parse_dates(df, "date")).filter("date is not null")
    for c, default in (("version", F.col("title")), ("description", F.lit(""))):
        df = df.withColumn(c, F.coalesce(F.col(c).cast("string"), default) if c in df.columns else default)
    return df.orderBy("date")


def stem(name: str) -> str:
    """A path's last part without its suffix, if it is one that read_table knows."""
    return re.sub(r"(?i)(?<=.)\.(csv|tsv|txt|jsonl?|parquet|orc|xlsx?)$", "", name.rstrip("/").rsplit("/", 1)[-1])


def channel_of(name: str) -> str:
    """A name without the date at its end, so that monthly exports are one channel."""
    return re.sub(r"[_\-. ]*\d{4,8}$", "", name) or name


def combine_feedback(sources: dict[str, str | DataFrame], spark: SparkSession | None = None) -> DataFrame:
    """Several exports as one, in order of time, then of the exports as given, then of their rows. Ids carry the export's name, of a path its stem, which without a date at its end also is the channel of an export without one."""
    parts = []
    for k, (given, source) in enumerate(sources.items()):
        name = stem(given)
        accounts = "account_id" in resolve(read_table(source, spark), FEEDBACK).columns
        df = load_feedback(source, spark)
        known = df.filter("channel != 'unknown'").limit(1).count()
        df = df.withColumn("feedback_id", F.concat(F.lit(f"{name}:"), "feedback_id"))
        parts.append(df.withColumns({"channel": F.col("channel") if known else F.lit(channel_of(name)), "account_id": F.col("account_id") if accounts else F.col("feedback_id"), "_source": F.lit(k)}))
    out = saved(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).withColumnRenamed("doc_id", "_place"), "combined")
    return numbered(out, [], [F.col("created_at"), F.col("_source"), F.col("_place")], "doc_id").drop("_source", "_place")
