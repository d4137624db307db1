"""Personal data: exact patterns, and terms that disclose a protected entity (information-theoretic sanitisation).

Patterns find e-mail and IP addresses, card and phone numbers, with positions in code points. Each span stands for three
protected entities: the value itself, the group that it shares with others (mail domain, network, card issuer, area code)
and its kind. The corpus tells how strongly a word discloses an entity: in how many differing texts each occurs, and both
together, anywhere in the text. A word discloses an entity if knowing it makes the entity likely, by CERTAINTY at least,
and its pointwise mutual information with the entity is at least DISCLOSURE of the entity's own information; both use the
smoothed share ``(both + PRIOR * p) / (texts with the word + PRIOR)``, p being the entity's share of all texts. Such words
become spans too, in the documents that hold the entity. Only DataFrame functions are used.

The patterns are those of the contract, written so that a match needs no backtracking: a run is entered at its start
only (or where the last match ended), and repeated groups are replaced by character runs with a look-ahead, which
keeps matches equal and very long texts from exhausting the stack.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedprofile.llm.storage import fresh, materialize

KINDS = ("email", "ip", "card", "phone")
TERM = "term"
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++\.[A-Za-z0-9-][A-Za-z0-9.-]*?(?=\.?(?:[^A-Za-z0-9.-]|\z)|\.\.)",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?=[\x20-]?[0-9])[0-9\x20-]*?[0-9](?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to have a chance; a plain search that spares most texts the patterns.
HINTS = {"email": r"@[A-Za-z0-9-]", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
OCTETS = r"^0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})(?:\.0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})){3}$"
#: Letters of a term, and the least number of differing texts in which a term meets an entity.
LEAST_LETTERS, LEAST_TEXTS = 3, 3
#: Share of an entity's information from which a term discloses it, and the least certainty that it gives.
DISCLOSURE, CERTAINTY = 0.8, 0.5
#: So many texts with the entity's own share count beside those with a term, lest few texts tell much.
PRIOR = 2.0
WORD = r"\p{L}{%d,}" % LEAST_LETTERS
PLACEHOLDERS = {"email": "<EMAIL>", "ip": "<IP>", "card": "<CARD>", "phone": "<PHONE>", TERM: "<TERM>"}
#: Candidate terms are broadcast up to this number and joined by shuffle beyond it.
BROADCAST_TERMS = 200_000
#: Hashes are broadcast up to this number (some 30 MB).
BROADCAST_HASHES = 1_000_000


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the Luhn sum of a string of digits is a multiple of ten."""
    back = F.transform(F.split(F.reverse(digits), ""), lambda d: d.cast("int"))
    doubled = F.transform(back, lambda d, i: F.when(i % 2 == 0, d).when(d > 4, d * 2 - 9).otherwise(d * 2))
    return F.aggregate(doubled, F.lit(0), lambda s, d: s + d) % 10 == 0


def _sound(kind: str, text: Column) -> Column:
    n = F.length(_digits(text))
    if kind == "ip":
        return text.rlike(OCTETS)
    if kind == "card":
        return F.when((n >= 12) & (n <= 19), _luhn(_digits(text))).otherwise(F.lit(False))
    if kind == "phone":
        return (n >= 9) & (n <= 15)
    return F.lit(True)


def _spans(kind: str, text: Column) -> Column:
    """Spans ``(start, stop, rank, kind, value)`` of a kind: the text between matches gives their positions."""
    pattern = F.lit(PATTERNS[kind])
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int,value:string>>").alias("found"))
    pieces = F.arrays_zip(F.split(text, PATTERNS[kind], -1).alias("gap"), F.regexp_extract_all(text, pattern, F.lit(0)).alias("hit"))

    def step(state: Column, piece: Column) -> Column:
        start = state["at"] + F.length(piece["gap"])
        stop = start + F.coalesce(F.length(piece["hit"]), F.lit(0))
        span = F.struct(start.alias("start"), stop.alias("stop"), piece["hit"].alias("value"))
        return F.struct(stop.alias("at"), F.when(piece["hit"].isNull(), state["found"]).otherwise(F.concat(state["found"], F.array(span))).alias("found"))

    found = F.aggregate(pieces, zero, step, lambda s: s["found"])
    kept = F.filter(found, lambda s: _sound(kind, s["value"]))
    rank = KINDS.index(kind)
    return F.transform(kept, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["stop"].alias("stop"), F.lit(kind).alias("kind"), s["value"].alias("value")))


_SPAN = "array<struct<start:int,rank:int,stop:int,kind:string,value:string>>"


def base_spans(text: Column) -> Column:
    """All pattern spans of a text, by start and then kind; null texts have none."""
    none = F.array().cast(_SPAN)
    parts = [F.when(text.rlike(HINTS[k]), _spans(k, text)).otherwise(none).cast(_SPAN) for k in KINDS]
    return F.coalesce(F.array_sort(F.concat(*parts)), none)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def _words(text: Column) -> Column:
    """Distinct lower-case words of LEAST_LETTERS letters or more."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda w: F.lower(w)))


def _entities(span: Column) -> Column:
    """Names of the entities that a span stands for: its value, the group of its value, its kind."""
    kind, value = span["kind"], F.lower(span["value"])
    digits = _digits(value)
    group = (
        F.when(kind == "email", F.substring_index(value, "@", -1)).when(kind == "ip", F.substring_index(value, ".", 2))
        .when(kind == "card", F.substring(digits, 1, 6)).otherwise(F.substring(digits, 1, 4))
    )
    return F.array(F.concat_ws("=", kind, value), F.concat_ws("~", kind, group), kind)


def _replaced(text: Column, spans: Column, by: Callable[[Column], Column]) -> Column:
    """The text with something else in the place of its spans; of overlapping spans the first counts."""
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(state: Column, s: Column) -> Column:
        out = F.concat(state["out"], F.substring(text, state["at"] + 1, s["start"] - state["at"]), by(s))
        return F.struct(F.greatest(state["at"], s["stop"]).alias("at"), F.when(s["start"] >= state["at"], out).otherwise(state["out"]).alias("out"))

    return F.aggregate(spans, zero, step, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))))


def _small(rows: DataFrame, most: int) -> DataFrame:
    """Marked for broadcast where it has no more than so many rows."""
    return F.broadcast(rows) if rows.count() <= most else rows


def _met(found: DataFrame, entities: DataFrame) -> DataFrame:
    """Pairs ``(h, entity, term)`` of each differing text of ``found(h, words, entities)`` whose entity is in ``entities``."""
    each = found.select("h", "words", F.explode("entities").alias("entity"))
    is_kind = F.col("entity").isin(*KINDS)  # the few kinds are hot keys and need no look-up
    kept = each.where(is_kind).unionByName(each.where(~is_kind).join(_small(entities.select("entity"), BROADCAST_TERMS), "entity", "left_semi"))
    return kept.select("h", "entity", F.explode("words").alias("term"))


def _document_frequencies(docs: DataFrame, texts: DataFrame, terms: DataFrame) -> DataFrame:
    """In how many differing texts of ``docs(text)`` the ``terms(t)`` occur: ``(t, df_term)``; ``texts(h, n)`` tells copies.

    Terms are told by their hashes. Texts that occur once are counted within tasks; only those of copies are told apart.
    """
    hashed = docs.select("text", F.xxhash64("text").alias("h"))
    copies = _small(materialize(texts.where("n > 1").select("h")), BROADCAST_HASHES)
    terms = _small(terms, BROADCAST_HASHES)
    spoken = lambda rows: rows.select("h", F.explode(F.transform(_words(F.col("text")), lambda w: F.xxhash64(w))).alias("t")).join(terms, "t", "left_semi")
    once = spoken(hashed.join(copies, "h", "left_anti")).groupBy("t").agg(F.count("*").alias("n"))
    again = spoken(hashed.join(copies, "h", "left_semi")).distinct().groupBy("t").agg(F.count("*").alias("n"))
    return once.unionByName(again).groupBy("t").agg(F.sum("n").alias("df_term"))


def disclosing_terms(found: DataFrame, entities: DataFrame, docs: DataFrame) -> DataFrame:
    """Pairs ``(entity, term)`` whose term discloses the entity, from ``found(h, words, entities)``, the differing texts
    with entities, ``entities(entity, df_entity)`` and all ``docs(text)``. Texts count once, however often they are copied."""
    texts = materialize(docs.select(F.xxhash64("text").alias("h")).groupBy("h").agg(F.count("*").alias("n")))
    base = F.col("df_entity") / F.lit(float(texts.count()))
    share = lambda df: (F.col("both") + PRIOR * base) / (F.col(df) + PRIOR)
    met = _met(found, entities).groupBy("entity", "term").agg(F.count("*").alias("both")).where(F.col("both") >= LEAST_TEXTS)
    seen = found.select(F.explode("words").alias("term")).groupBy("term").agg(F.count("*").alias("seen")).where(F.col("seen") >= LEAST_TEXTS)
    # a term is in at least the texts with entities that hold it, so words of many such texts are out already
    met = met.join(seen, "term").join(_small(entities, BROADCAST_TERMS), "entity").where(share("seen") >= CERTAINTY)
    met = materialize(met.select("entity", "term", "both", "df_entity", F.xxhash64("term").alias("t")))
    if met.isEmpty():
        return met.select("entity", "term")
    terms = _document_frequencies(docs, texts, materialize(met.select("t").distinct()))
    told = met.join(terms, "t").where((share("df_term") >= CERTAINTY) & (F.log2(share("df_term") / base) >= DISCLOSURE * F.log2(1 / base)))
    return materialize(told.select("entity", "term"))


def find_personal_data(docs: DataFrame, base: str = "base", every: str = "all_spans") -> DataFrame:
    """``docs`` plus ``base`` (pattern spans) and ``every`` (with disclosing terms), arrays sorted by start and kind.

    Null texts are empty and have no spans. Rows with repeated or null ids are documents like any other. Overlapping spans
    of different kinds all stay. Columns of ``docs`` with the new names are replaced; an empty table gives no rows.
    """
    docs = docs.drop(base, every)
    rows = docs.withColumn(base, base_spans(F.col("text")))
    own = docs.select("text").withColumn("base", base_spans(F.col("text"))).where(F.size("base") > 0)
    outside = _replaced(F.col("text"), F.col("base"), lambda s: F.lit(" "))
    found = own.select(F.xxhash64("text").alias("h"), _words(outside).alias("words"), F.array_distinct(F.flatten(F.transform("base", _entities))).alias("entities"))
    found = materialize(found.dropDuplicates(["h"]))
    entities = found.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count("*").alias("df_entity"))
    entities = materialize(entities.where(F.col("df_entity") >= LEAST_TEXTS))
    told = disclosing_terms(found, entities, docs)
    if told.isEmpty():
        return rows.withColumn(every, F.col(base))
    # terms of each text that holds their entity
    hash_, terms = fresh("_h", rows.columns), fresh("_terms", rows.columns)
    per_text = _met(found, entities).join(_small(told, BROADCAST_TERMS), ["entity", "term"], "left_semi").groupBy(F.col("h").alias(hash_)).agg(F.collect_set("term").alias(terms))
    per_text = _small(materialize(per_text), BROADCAST_TERMS)
    joined = rows.join(per_text, F.xxhash64(rows["text"]) == per_text[hash_], "left")
    spans = F.array_sort(F.concat(F.col(base), _term_spans(F.col("text"), F.col(terms), F.col(base))))
    return joined.withColumn(every, F.when(F.col(terms).isNull(), F.col(base)).otherwise(spans)).select(*rows.columns, every)


def _term_spans(text: Column, terms: Column, base: Column) -> Column:
    """Spans of the words of a text that are among the terms and outside the pattern spans."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("found"))
    pieces = F.arrays_zip(F.split(text, WORD, -1).alias("gap"), F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("hit"))

    def step(state: Column, piece: Column) -> Column:
        start = state["at"] + F.length(piece["gap"])
        stop = start + F.coalesce(F.length(piece["hit"]), F.lit(0))
        span = F.struct(start.alias("start"), F.lit(len(KINDS)).alias("rank"), stop.alias("stop"), F.lit(TERM).alias("kind"), piece["hit"].alias("value"))
        told = piece["hit"].isNotNull() & F.array_contains(terms, F.lower(piece["hit"])) & ~F.exists(base, lambda b: (b["start"] < stop) & (b["stop"] > start))
        return F.struct(stop.alias("at"), F.when(told, F.concat(state["found"], F.array(span).cast(_SPAN))).otherwise(state["found"]).alias("found"))

    return F.aggregate(pieces, zero, step, lambda s: s["found"])


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts by kind and the joined spans of ``find_personal_data``'s rows."""
    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in KINDS]
    return found.select(id_col, *counts, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("all_spans")).alias("spans"))


def sanitize(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of ``text`` generalised to the name of its kind; of overlapping spans the first counts.

    Texts without spans, null ones included, stay as they are.
    """
    names = F.create_map(*[F.lit(x) for pair in PLACEHOLDERS.items() for x in pair])
    base, every = fresh("_base", docs.columns), fresh("_every", docs.columns)
    clean = _replaced(F.col("text"), F.col(every), lambda s: F.element_at(names, s["kind"]))
    found = find_personal_data(docs, base, every)
    return found.withColumn("text", F.when(F.size(every) > 0, clean).otherwise(F.col("text"))).select(*docs.columns)
