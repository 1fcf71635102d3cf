"""Readers of raw public files: trailer files, TSV, vintage JSON, filing indexes, company facts (inventory A5-A12)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scalars import finite, require_columns, safe_div
from tidemark.operators.order import top_rows


def read_trailer_files(spark: SparkSession, path: str, columns: Sequence[str], **typing) -> tuple[DataFrame, DataFrame]:
    """A5. Delimited files with a header and a record count as their last line: (rows, file log)."""
    lines = spark.read.text(path).select(
        F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file_name"), "value")
    return parse_trailer_lines(lines, columns, **typing)


def parse_trailer_lines(lines: DataFrame, columns: Sequence[str], integers: Sequence[str] = (),
                        dates: Sequence[str] = (), date_format: str = "yyyyMMdd",
                        sep: str = "|") -> tuple[DataFrame, DataFrame]:
    """A5. (file_name, value) lines in any order -> (rows, file log).

    A line of digits only is a trailer (a record has separators), so files may be split and lines spread over tasks.
    Reading the log of a file without the expected header fails the query.
    """
    require_columns(lines, "file_name", "value")
    text = F.regexp_replace("value", r"\r$", "")
    is_header, is_trailer = text == sep.join(columns), F.trim(text).rlike(r"^\d+$")
    kind = F.when(is_header, "header").when(is_trailer, "trailer").when(text == "", "blank").otherwise("record")
    d = lines.select("file_name", text.alias("line"), kind.alias("kind"))
    cells = d.where(F.col("kind") == "record").select("file_name", F.split("line", "\\Q" + sep + "\\E").alias("c"))
    def typed(i, name):
        c = F.get("c", F.lit(i))
        if name in integers:
            return c.try_cast("long").alias(name)
        if name in dates:
            return F.to_date(F.try_to_timestamp(c, F.lit(date_format))).alias(name)
        return c.alias(name)
    rows = cells.select("file_name", *[typed(i, n) for i, n in enumerate(columns)])
    log = d.groupBy("file_name").agg(
        F.count(F.when(F.col("kind") == "record", 1)).alias("n_records"),
        F.max(F.when(F.col("kind") == "trailer", F.trim("line").try_cast("long"))).alias("trailer_count"),
        F.count(F.when(F.col("kind") == "header", 1)).alias("_headers"))
    day = F.to_date(F.try_to_timestamp(F.regexp_extract("file_name", r"(\d{8})\.[^.]*$", 1), F.lit("yyyyMMdd")))
    checked = F.when(F.col("_headers") == 1, F.col("n_records")).otherwise(
        F.raise_error(F.concat(F.lit("unexpected header in "), "file_name")).cast("long"))
    log = log.select("file_name", day.alias("file_date"), checked.alias("n_records"), "trailer_count")
    return rows, log.withColumn("trailer_ok", F.coalesce(F.col("trailer_count") == F.col("n_records"), F.lit(False)))


def read_tsv(spark: SparkSession, path: str, date_cols: Sequence[str] = (), num_cols: Sequence[str] = (),
             date_format: str = "dd-MMM-yyyy") -> DataFrame:
    """A6. Tab-separated text without quoting; named dates and numbers are coerced."""
    df = spark.read.csv(path, sep="\t", header=True, quote="", escape="", inferSchema=False)
    return coerce_text(df, date_cols, num_cols, date_format)


def coerce_text(df: DataFrame, date_cols: Sequence[str] = (), num_cols: Sequence[str] = (),
                date_format: str = "dd-MMM-yyyy") -> DataFrame:
    """A6. Text columns to dates (01-JAN-2025) and numbers; what does not parse is null."""
    require_columns(df, *date_cols, *num_cols)
    fixes = {c: F.to_date(F.try_to_timestamp(F.initcap(F.lower(c)), F.lit(date_format))) for c in date_cols}
    fixes.update({c: finite(F.col(c).try_cast("double")) for c in num_cols})
    return df.withColumns(fixes) if fixes else df


_OBSERVATION = "array<struct<date:string,realtime_start:string,realtime_end:string,value:string>>"


def read_vintages(spark: SparkSession, path: str, suffix: str = r"_all_vintages\.json$") -> DataFrame:
    """A7. Vintage JSON files (one per series, named after it) as a long table; '.' is missing."""
    df = spark.read.schema(f"observations {_OBSERVATION}").json(path, multiLine=True)
    name = F.regexp_replace(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1), suffix, "")
    o = df.select(name.alias("series_id"), F.explode("observations").alias("o"))
    return flatten_vintages(o)


def flatten_vintages(o: DataFrame) -> DataFrame:
    """(series_id, o) rows with an observation struct of strings -> typed columns."""
    def day(c):
        return F.col(f"o.{c}").try_cast("date").alias(c)
    return o.select("series_id", day("date"), day("realtime_start"), day("realtime_end"),
                    F.col("o.value").try_cast("double").alias("value"))


META_FIELDS = ("id", "title", "frequency", "frequency_short", "units", "seasonal_adjustment", "observation_start",
               "observation_end", "last_updated", "notes")


def read_series_meta(spark: SparkSession, path: str) -> DataFrame:
    """A7. Series metadata rows."""
    fields = ",".join(f"{f}:string" for f in META_FIELDS)
    df = spark.read.schema(f"seriess array<struct<{fields}>>").json(path, multiLine=True)
    return df.select(F.explode("seriess").alias("s")).select("s.*").withColumnRenamed("id", "series_id")


_ARRAYS = ("accessionNumber", "filingDate", "acceptanceDateTime", "form")
_BLOCK = "struct<" + ",".join(f"{a}:array<string>" for a in _ARRAYS) + ">"
FILING_SCHEMA = f"cik string, recent {_BLOCK}"


def flatten_filing_index(df: DataFrame, lo: str, hi: str) -> DataFrame:
    """A8. Parallel arrays per filer -> one row per filing in the date window.

    df: cik, recent (struct of arrays) or block of an overflow file under the same name; union both before.
    """
    z = df.select("cik", F.explode(F.arrays_zip(*[F.col(f"recent.{a}").alias(a) for a in _ARRAYS])).alias("f"))
    f = z.select(F.col("f.accessionNumber").alias("accession"), "cik", "f.form",
                 F.col("f.filingDate").alias("filingDate"), F.col("f.acceptanceDateTime").alias("acceptanceDateTime"))
    return f.where(F.col("filingDate").between(lo, hi))


def read_filing_index(spark: SparkSession, path: str, lo: str, hi: str, overflow: str | None = None) -> DataFrame:
    """A8. Filer JSON files (and the overflow files they name, when they lie in a folder) -> filings in the window."""
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    cik = F.regexp_extract(name, r"CIK(\d+)", 1)
    main = spark.read.schema(f"filings struct<recent:{_BLOCK}>").json(path, multiLine=True).select(
        cik.alias("cik"), F.col("filings.recent").alias("recent"))
    if overflow:
        more = spark.read.schema(", ".join(f"{a} array<string>" for a in _ARRAYS)).json(overflow, multiLine=True)
        main = main.unionByName(more.select(cik.alias("cik"), F.struct(*_ARRAYS).alias("recent")))
    return flatten_filing_index(main, lo, hi)


def two_pass_match(wanted: DataFrame, pass1: DataFrame, pass2: DataFrame, key: str, order_by: Sequence[str],
                   via: tuple[str, str] = ("issuer", "owner")) -> tuple[DataFrame, DataFrame]:
    """A9. Matches of the wanted keys: the first pass, and the second only for keys it left open; one row per key.
    Returns (matched, rate)."""
    w = wanted.select(key).where(F.col(key).isNotNull()).distinct()
    first = pass1.join(w, key, "left_semi")
    open_keys = w.join(first.select(key), key, "left_anti")
    second = pass2.join(open_keys, key, "left_semi")
    found = first.withColumn("scanned_via", F.lit(via[0])).unionByName(second.withColumn("scanned_via", F.lit(via[1])))
    matched = top_rows(found, [key], [F.col(c) for c in order_by], 1)
    got = w.join(matched.select(key, F.lit(1).alias("_hit")), key, "left")
    rate = got.agg(F.count(F.lit(1)).alias("wanted"), F.count("_hit").alias("matched"))
    return matched, rate.withColumns({"unmatched": F.col("wanted") - F.col("matched"),
                                      "match_rate": safe_div(F.col("matched"), F.col("wanted"))})


_FACT = "array<struct<end:string,filed:string,form:string,val:double>>"
# Item -> (namespace, tag) of the company facts.
FACT_ITEMS = {"public_float": ("dei", "EntityPublicFloat"), "assets": ("us-gaap", "Assets")}


def flatten_facts(df: DataFrame, items: Mapping[str, tuple[str, str]] = FACT_ITEMS, unit: str = "USD") -> DataFrame:
    """A10. (cik, facts JSON text) -> (cik, item, end, filed, form, val): known values only, one per (cik, item, end,
    filed)."""
    require_columns(df, "cik", "facts")
    # only the tags that are asked for are parsed; a document has thousands of others
    tags: dict[str, dict[str, None]] = {}
    for ns, tag in items.values():
        tags.setdefault(ns, {})[tag] = None
    spaces = (f"`{ns}`:struct<{','.join(f'`{t}`:struct<units:struct<`{unit}`:{_FACT}>>' for t in names)}>" for ns, names in tags.items())
    d = df.select("cik", F.from_json("facts", f"struct<{','.join(spaces)}>").alias("f"))
    def rows(item, ns, tag):
        found = F.col("f")[ns][tag]["units"][unit]
        return F.transform(found, lambda r: F.struct(F.lit(item).alias("item"), r["end"].try_cast("date").alias("end"),
                                                     r["filed"].try_cast("date").alias("filed"), r["form"].alias("form"),
                                                     r["val"].alias("val")))
    each = [F.coalesce(rows(i, ns, tag), F.array().cast(
        "array<struct<item:string,end:date,filed:date,form:string,val:double>>")) for i, (ns, tag) in items.items()]
    out = d.select("cik", F.explode(F.concat(*each)).alias("r")).select("cik", "r.*")
    out = out.where(F.col("end").isNotNull() & F.col("filed").isNotNull() & F.col("val").isNotNull())
    return top_rows(out, ["cik", "item", "end", "filed"], [F.asc_nulls_last("form"), F.asc("val")], 1)


# Industry code ranges of each sector, in order; the first that holds a code wins.
SECTOR_RANGES = (
    ("Energy", ((1300, 1399), (2900, 2999))),
    ("Health care", ((2830, 2836), (3840, 3851), (8000, 8099))),
    ("Technology", ((3570, 3579), (3600, 3699), (3810, 3829), (7370, 7379))),
    ("Financials", ((6000, 6799),)),
    ("Utilities", ((4900, 4999),)),
    ("Telecom & media", ((4800, 4899), (2700, 2799), (7810, 7819))),
    ("Materials", ((1000, 1299), (1400, 1499), (2400, 2699), (2800, 2829), (2840, 2899), (3200, 3399))),
    ("Consumer", ((100, 999), (2000, 2399), (2500, 2599), (3711, 3716), (3940, 3949), (5000, 5999), (7000, 7299),
                  (7800, 7999))),
    ("Industrials", ((1500, 1799), (3400, 3569), (3580, 3599), (3700, 3799), (3900, 3999), (4000, 4799),
                     (7300, 7369), (7380, 7399), (8700, 8799))),
)


def range_label(c: Column, ranges=SECTOR_RANGES, unknown: str = "Unknown", other: str = "Other") -> Column:
    """A11. The first label whose ranges (ends included) hold the code."""
    code = c.cast("string").try_cast("int")
    out = F.when(code.isNull(), unknown)
    for label, spans in ranges:
        hit = F.lit(False)
        for lo, hi in spans:
            hit = hit | code.between(lo, hi)
        out = out.when(hit, label)
    return out.otherwise(other)


def map_symbols(symbols: DataFrame, tickers: DataFrame, attributes: DataFrame, code: str = "sic") -> DataFrame:
    """A12. Symbols ('BRK/B') joined to the ticker list ('BRK-B'), with filer attributes and sector.

    symbols: symbol; tickers: sec_ticker, cik, name; attributes: cik and the industry code.
    """
    s = symbols.select("symbol").where(F.col("symbol").isNotNull()).distinct()
    s = s.withColumn("sec_ticker", F.replace("symbol", F.lit("/"), F.lit("-")))
    t = top_rows(tickers, ["sec_ticker"], [F.asc("cik")], 1)
    a = top_rows(attributes, ["cik"], [F.asc_nulls_last(code)], 1)
    m = s.join(t, "sec_ticker").join(a, "cik", "left")
    return m.withColumn("sector", range_label(F.col(code)))
