"""PII: information-theoretic sanitisation, in DataFrame expressions only.

Patterns find entities (email, ip, card, phone).  What protects an entity is not only its own removal: terms of its documents
may reveal it.  The corpus says how much.  For an entity e and a term t that stands anywhere in a document of e, the documents
that hold e, t and both are counted; t discloses the share PMI(e; t) / IC(e) of e's information, which is 1 where t never
occurs without e and 0 where they are independent.  Terms that at least ``SUPPORT`` documents hold together with e and whose
share reaches ``GENERALISE`` are generalised wherever they stand in a document that holds e, those that reach ``REMOVE`` are
removed there.

Entities, terms and their pairs are counted with map-side aggregation.  A pair is made only where both counts leave it a
share of ``GENERALISE``: the bound is exact, since no pair is in more documents than its entity.

Defined results: a null text is empty; documents are told apart by id and text, so repeated rows are one document and get the
same spans; a null id is an id.  Terms of under ``LETTERS`` letters and terms that overlap another span are left alone, and
are not counted.  Of one kind, spans are the leftmost matches that do not overlap, found before any is judged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.frames import broadcast_checked, fresh, text_of
from tidemark.session import cut

#: What is looked for, so that a search does no work twice: a match starts where a run starts, and runs are never given back.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
TERM = r"\p{L}[\p{L}\p{M}]*+"
#: An email with the term that overlaps its start or its end; no other kind holds letters.
COVERED = rf"(?:\p{{L}}[\p{{L}}\p{{M}}]*(?=[A-Za-z]))?{PATTERNS['email']}(?:(?<=[A-Za-z])[\p{{L}}\p{{M}}]*+)?"
SUPPORT, LETTERS = 3, 4
GENERALISE, REMOVE = 0.75, 0.95
#: What stands for a span in a sanitised text.
MARKS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "term": "[TERM]", "removed": ""}

_SPANS = "array<struct<start:int,end:int,value:string>>"
_TERMS = "array<struct<start:int,end:int,share:double>>"


def located(text: Column, pattern: str) -> Column:
    """The matches with their places in code points, end exclusive."""
    values = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    gaps = F.split(text, pattern, -1)
    pairs = F.zip_with(values, F.slice(gaps, 1, F.greatest(F.size(gaps) - 1, F.lit(0))), lambda v, g: F.struct(v.alias("value"), F.char_length(g).alias("gap")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(_SPANS).alias("spans"))

    def step(a: Column, p: Column) -> Column:
        begin = a["at"] + p["gap"]
        end = begin + F.char_length(p["value"])
        return F.struct(end.alias("at"), F.array_append(a["spans"], F.struct(begin.alias("start"), end.alias("end"), p["value"].alias("value"))).alias("spans"))
    return F.aggregate(pairs, start, step, lambda a: a["spans"])


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the check digit holds: from the right, every second digit counts double, the sum of its digits taken."""
    def weight(i: Column) -> Column:
        d = F.substring(digits, F.char_length(digits) - i, F.lit(1)).cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
        return F.when(d > 9, d - 9).otherwise(d)
    return F.aggregate(F.sequence(F.lit(0), F.char_length(digits) - 1), F.lit(0), lambda a, i: a + weight(i)) % 10 == 0


def holds(kind: str, value: Column) -> Column:
    """Whether a match is what it looks like."""
    size = F.char_length(_digits(value))
    if kind == "ip":
        part = lambda p: F.coalesce(p.try_cast("bigint") <= 255, F.lit(False))
        return F.forall(F.split(value, r"\.", -1), part)
    if kind == "card":
        return F.when((size >= 13) & (size <= 19), _luhn(_digits(value))).otherwise(F.lit(False))
    return (size >= 9) & (size <= 15) if kind == "phone" else F.lit(True)


def _real(kind: str) -> Column:
    return F.filter(f"all_{kind}", lambda s: holds(kind, s["value"]))


def entities(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, a column of spans for each kind, and held: the names of the document's entities, each once."""
    t = docs.select("doc_id", text_of().alias("q_text"))
    for kind, pattern in PATTERNS.items():
        t = t.withColumn(f"all_{kind}", located(F.col("q_text"), pattern))
    t = t.select("doc_id", "q_text", *(_real(k).alias(k) for k in PATTERNS))
    named = lambda k: F.transform(k, lambda s: F.concat(F.lit(f"{k}:"), _plain(k, s["value"])))
    return t.select("doc_id", F.xxhash64("q_text").alias("text_hash"), *PATTERNS, F.array_distinct(F.concat(*(named(k) for k in PATTERNS))).alias("held"))


def _terms(text: Column) -> Column:
    """The terms of a text that overlap no span, in lower case, each once."""
    free = F.when(F.contains(text, F.lit("@")), F.regexp_extract_all(text, F.lit(f"{COVERED}|({TERM})"), F.lit(1))).otherwise(
        F.regexp_extract_all(text, F.lit(f"({TERM})"), F.lit(1)))
    return F.array_distinct(F.transform(F.filter(free, lambda t: F.char_length(t) >= LETTERS), F.lower))


def _plain(kind: str, value: Column) -> Column:
    return F.lower(value) if kind in ("email", "ip") else _digits(value)


def _same(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """left joined to right, a row per document, by id and text; right's columns doc_id and text_hash go."""
    keyed = right.withColumnsRenamed({"doc_id": "q_doc", "text_hash": "q_hash"})
    on = F.col("doc_id").eqNullSafe(F.col("q_doc")) & (F.col("text_hash") == F.col("q_hash"))
    return left.join(keyed, on, how).drop("q_doc", "q_hash")


def _counted(rows: DataFrame, *by: str) -> DataFrame:
    """How many documents stand behind rows, one for each row of documents; only those that ``again`` marks are looked at by id and text."""
    each = rows.groupBy(*by, F.when(F.col("again"), F.struct("doc_id", "text_hash")).alias("q_once")).agg(F.count(F.lit(1)).alias("n"))
    return each.groupBy(*by).agg(F.sum(F.when(F.col("q_once").isNull(), F.col("n")).otherwise(F.lit(1))).alias("n"))


def disclosing(found: DataFrame, docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, term, share: in each document the terms that disclose at least GENERALISE of the information of an
    entity that the document holds, with the largest such share."""
    per = cut(found.groupBy("doc_id", "text_hash").agg(F.max("held").alias("held"), F.count(F.lit(1)).alias("copies")))
    total = float(per.count())
    own = cut(per.select(F.explode("held").alias("entity")).groupBy("entity").agg(F.count(F.lit(1)).alias("with_entity")).where(F.col("with_entity") >= SUPPORT))
    # the share reaches GENERALISE only if the whole corpus holds the term at most this often; both is at most with_entity
    most = lambda both, entity: both * F.pow(F.lit(total) / entity, F.lit(1 - GENERALISE)) * (1 + 1e-9)
    top = own.agg(F.max(most(F.col("with_entity"), F.col("with_entity")))).first()[0]
    said = docs.select("doc_id", text_of().alias("q_text")).select("doc_id", F.xxhash64("q_text").alias("text_hash"), _terms(F.col("q_text")).alias("terms"))
    repeated = cut(per.where(F.col("copies") > 1).select("doc_id", "text_hash", F.lit(True).alias("again")))
    marked = _same(said, broadcast_checked(repeated, 100), "left").withColumn("again", F.coalesce("again", F.lit(False)))
    held = _counted(marked.select("doc_id", "text_hash", "again", F.explode("terms").alias("term")), "term").withColumnRenamed("n", "with_term")
    held = broadcast_checked(cut(held.where((F.col("with_term") >= SUPPORT) & (F.col("with_term") <= F.lit(top)))), 100)
    # the documents of entities that enough documents hold, each with its entities
    named = per.select("doc_id", "text_hash", (F.col("copies") > 1).alias("again"), F.explode("held").alias("entity")).join(broadcast_checked(own, 150), "entity")
    who = cut(named.groupBy("doc_id", "text_hash", "again").agg(F.collect_list(F.struct("entity", "with_entity")).alias("who")))
    rows = _same(said, broadcast_checked(who, 400), "inner").select("doc_id", "text_hash", "again", "who", F.explode("terms").alias("term"))
    able = F.filter("who", lambda w: F.col("with_term") <= most(w["with_entity"], w["with_entity"]))
    near = rows.join(held, "term").select("doc_id", "text_hash", "again", "term", "with_term", F.explode(able).alias("w")).select("*", "w.*").drop("w")
    pairs = _counted(near, "entity", "term", "with_entity", "with_term").withColumnRenamed("n", "both").where(F.col("both") >= SUPPORT)
    info = F.log(F.lit(total) / F.col("with_entity"))
    point = F.log(F.col("both") * F.lit(total) / (F.col("with_entity") * F.col("with_term")))
    told = pairs.withColumn("share", F.coalesce(point / F.nullif(info, F.lit(0.0)), F.lit(0.0))).where(F.col("share") >= GENERALISE)
    told = cut(told.select("entity", "term", "share"))
    terms = broadcast_checked(cut(told.select("term").distinct()), 100)
    spoken = rows.join(terms, "term", "left_semi").select("doc_id", "text_hash", "term", F.explode("who.entity").alias("entity"))
    return spoken.join(broadcast_checked(told, 150), ["entity", "term"]).groupBy("doc_id", "text_hash", "term").agg(F.max("share").alias("share"))


def _spots(text: Column, told: Column) -> Column:
    """Every place of the terms of the map ``told``, with their shares; only these places are gathered."""
    values = F.regexp_extract_all(text, F.lit(f"({TERM})"), F.lit(1))
    pairs = F.arrays_zip(values.alias("value"), F.slice(F.split(text, TERM, -1), F.lit(1), F.size(values)).alias("gap"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(_TERMS).alias("spots"))

    def step(a: Column, p: Column) -> Column:
        begin = a["at"] + F.char_length(p["gap"])
        end, share = begin + F.char_length(p["value"]), F.try_element_at(told, F.lower(p["value"]))
        spot = F.struct(begin.alias("start"), end.alias("end"), share.alias("share"))
        return F.struct(end.alias("at"), F.when(share.isNotNull() & (F.char_length(p["value"]) >= LETTERS), F.array_append(a["spots"], spot)).otherwise(a["spots"]).alias("spots"))
    return F.aggregate(pairs, start, step, lambda a: a["spots"])


def personal_spans(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, a column of spans for each kind, and terms: (start, end, share) of disclosing ones; a row per document row."""
    found = cut(entities(docs))
    told = disclosing(found, docs).groupBy("doc_id", "text_hash").agg(F.map_from_entries(F.collect_list(F.struct("term", "share"))).alias("told"))
    texts = docs.select("doc_id", text_of().alias("q_text")).withColumn("text_hash", F.xxhash64("q_text"))
    spots = _same(texts, broadcast_checked(cut(told), 400), "inner").select("doc_id", "text_hash", _spots(F.col("q_text"), F.col("told")).alias("spots"))
    spots = cut(spots.dropDuplicates(["doc_id", "text_hash"]))
    base = F.concat(*(F.transform(k, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))) for k in PATTERNS))
    rows = _same(found, broadcast_checked(spots, 400), "left").withColumn("q_base", base)
    free = F.filter("spots", lambda t: ~F.exists("q_base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))
    return rows.select("doc_id", "text_hash", *PATTERNS, F.coalesce(free, F.array().cast(_TERMS)).alias("terms"))


def sanitised(docs: DataFrame) -> DataFrame:
    """docs with every span replaced by its mark; other columns pass.  Spans meet their documents again by id and text."""
    spans = personal_spans(docs).dropDuplicates(["doc_id", "text_hash"])
    mark = lambda s, m: F.struct(s["start"].alias("start"), s["end"].alias("end"), m.alias("mark"))
    shown = lambda k: lambda s: mark(s, F.lit(MARKS[k]))
    marks = F.array_sort(F.concat(*(F.transform(k, shown(k)) for k in PATTERNS),
                                  F.transform("terms", lambda s: mark(s, F.when(s["share"] >= REMOVE, MARKS["removed"]).otherwise(MARKS["term"])))))
    spans = spans.select(F.struct("doc_id", "text_hash", marks.alias("marks")).alias("q_spans"))
    text, name = text_of(), fresh(docs, "q_hash")
    rows = docs.withColumn(name, F.xxhash64(text)).join(spans, (F.col("q_spans.text_hash") == F.col(name)) & F.col("q_spans.doc_id").eqNullSafe(F.col("doc_id")), "left")
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(a: Column, s: Column) -> Column:
        kept = F.concat(a["out"], F.substring(text, a["at"] + 1, F.greatest(s["start"] - a["at"], F.lit(0))))
        # a span within the one before goes with it
        return F.when(s["start"] >= a["at"], F.struct(s["end"].alias("at"), F.concat(kept, s["mark"]).alias("out"))).otherwise(
            F.struct(F.greatest(a["at"], s["end"]).alias("at"), a["out"].alias("out")))
    clean = F.aggregate("q_spans.marks", start, step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.char_length(text))))
    return rows.withColumn("text", F.coalesce(clean, text)).select(*(f"`{c}`" for c in docs.columns))


def _told(kind: str, spans: str) -> Column:
    return F.transform(spans, lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string")))


def disclosure_report(docs: DataFrame) -> DataFrame:
    """Counts and spans of personal data, a row per document row."""
    spans = personal_spans(docs)
    base = F.concat(*(_told(k, k) for k in PATTERNS))
    return spans.select("doc_id", *(F.size(k).cast("long").alias(f"n_{k}") for k in PATTERNS),
                        F.sha2(F.array_join(base, ",").cast("binary"), 256).alias("base_sha256"),
                        F.array_join(F.concat(base, _told("term", "terms")), ",").alias("spans"), F.size("terms").cast("long").alias("n_terms"))
