"""Personal data: patterns find the protected entities, information theory the terms that give them away
(after Sanchez, Batet and Viejo, "Automatic general-purpose sanitization of textual documents").

An entity is a matched address, number or card. Its information is log2(N / documents with it). A term in the
same document discloses the part pmi(term, entity) / information of it, where the pointwise mutual information
comes from document counts over the whole corpus. Terms above the first threshold are generalised, above the
second removed, at every place in the documents of the entity. DataFrame functions only: texts never leave the JVM.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from stallkeeper.llm.common import packed, stored

KINDS = ("email", "ip", "card", "phone")
# The patterns of the contract. Possessive repeats and the look-behind change no match: they only stop the
# engine from trying starts inside a run that failed at its start, and from recursion on long runs.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# A text without this has no valid match.
HINTS = {"email": "@[A-Za-z0-9-]", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){15}", "phone": r"\+[0-9]"}
BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9][0-9]?)"
TERM = r"\p{L}[\p{L}\p{N}_-]*+"
CHUNK = 256         # matches whose places are added up at a time
FREQUENT = 1000     # most frequent terms, dropped before the join where they can give nothing away
GENERALISE, REMOVE = 0.8, 0.95
SPAN = "struct<start:int,stop:int,found:string>"


def spans(text: Column, pattern: str) -> Column:
    """All matches with their places (code points, end exclusive): the text between matches and the matches
    have known lengths."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
    pieces = F.zip_with(between, found, lambda b, m: F.struct(F.char_length(b).alias("gap"), m.alias("found")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("spans"))

    def step(acc, piece):
        begin = acc["at"] + piece["gap"]
        end = begin + F.char_length(piece["found"])
        return F.struct(end.alias("at"), F.concat(acc["spans"], F.array(F.struct(
            begin.alias("start"), end.alias("stop"), piece["found"].alias("found")))).alias("spans"))

    # Places within chunks, then the chunks one after the other: work stays linear in long texts.
    def chunks(all_pieces):
        edges = F.filter(F.sequence(F.lit(0), F.size(all_pieces), F.lit(CHUNK)), lambda i: i < F.size(all_pieces))
        return F.transform(edges, lambda i: F.aggregate(F.slice(all_pieces, i + 1, F.lit(CHUNK)), start, step))

    def follow(acc, chunk):
        moved = F.transform(chunk["spans"], lambda x: F.struct(
            (x["start"] + acc["at"]).alias("start"), (x["stop"] + acc["at"]).alias("stop"), x["found"].alias("found")))
        return F.struct((acc["at"] + chunk["at"]).alias("at"), F.concat(acc["parts"], F.array(moved)).alias("parts"))

    none = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<array<{SPAN}>>").alias("parts"))
    held = F.transform(F.array(pieces), chunks)[0]
    return F.aggregate(held, none, follow, lambda acc: F.flatten(acc["parts"]))


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the check: from the right, every second digit counts double."""
    back = F.transform(F.filter(F.split(F.reverse(digits), ""), lambda d: d != ""), lambda d, i: F.when(
        i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(back, F.lit(0), lambda a, d: a + d) % 10 == 0


def valid(kind: str, found: Column) -> Column:
    digits = F.regexp_replace(found, "[^0-9]", "")
    size = F.char_length(digits)
    if kind == "ip":
        return found.rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$")
    if kind == "card":
        return F.when(size.between(16, 19), luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return size.between(8, 15)
    return F.lit(True)


def entities(text: Column) -> Column:
    """Valid matches of all kinds: array of (kind, start, stop, found), by kind as listed, then start."""
    none = F.array().cast(f"array<{SPAN}>")

    def of(kind: str) -> Column:
        hit = F.when(text.rlike(HINTS[kind]), F.filter(spans(text, PATTERNS[kind]), lambda s: valid(kind, s["found"])))
        return F.transform(F.coalesce(hit, none), lambda s: F.struct(
            F.lit(kind).alias("kind"), s["start"].alias("start"), s["stop"].alias("stop"), s["found"].alias("found")))

    return F.concat(*map(of, KINDS))


def words(text: Column, base: Column) -> Column:
    """All words of a text that overlap no entity: array of (term, start, stop)."""
    most = F.array_max(F.transform(base, lambda e: e["stop"]))
    least = F.array_min(F.transform(base, lambda e: e["start"]))
    clear = lambda t: (t["start"] >= most) | (t["stop"] <= least) | ~F.exists(
        base, lambda e: (t["start"] < e["stop"]) & (e["start"] < t["stop"]))
    return F.transform(F.filter(spans(text, TERM), clear), lambda s: F.struct(
        F.lower(s["found"]).alias("term"), s["start"].alias("start"), s["stop"].alias("stop")))


def _joined(all_spans: Column) -> Column:
    return F.array_join(F.transform(all_spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def find(docs: DataFrame, generalise: float = GENERALISE) -> DataFrame:
    """One row per row of ``docs``: doc_id, dk (hash of the text), base (valid matches), terms (array of start,
    stop, disclosure; sorted, each place once with its largest disclosure).

    A null text counts as empty. Documents without an entity have no terms. An entity that every document has
    holds no information and is given away by nothing. Rows that repeat id and text share their spans. An empty
    table gives no rows.
    """
    texts = _keyed(docs)
    base = texts.select("doc_id", F.xxhash64("text").alias("dk"), "text", entities(F.col("text")).alias("base"))
    own = F.when(F.size("base") > 0, words(F.col("text"), F.col("base")))
    rows = stored(base.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "dk", "base", own.alias("words")))
    total = rows.count()
    held = rows.where(F.size("base") > 0)
    whose = held.select("rid", F.explode(F.array_distinct(F.transform(
        "base", lambda e: F.xxhash64(e["kind"], e["found"])))).alias("entity"))
    holders = stored(whose.groupBy("entity").agg(F.count(F.lit(1)).alias("n_entity")))
    # A term in more documents than this can disclose no entity to the threshold, even if it is in all of its own.
    limit = lambda n: F.lit(float(max(total, 1)) ** (1 - generalise) * (1 + 1e-9)) * F.pow(n, F.lit(generalise))
    widest = holders.agg(F.max("n_entity")).first()[0] or 0
    # Documents with each term of the corpus, counted in the tasks that read the texts.
    every = F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(TERM), F.lit(0)), F.lower))
    counted = stored(texts.select(F.explode(every).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n_term")))
    rare = counted.where(F.col("n_term") <= limit(F.lit(widest)))
    frequent = counted.where(F.col("n_term") > limit(F.lit(widest))).orderBy(F.desc("n_term"), "term").limit(FREQUENT)
    met = (held.select("rid", F.explode(F.array_distinct(F.transform("words", lambda w: w["term"]))).alias("term"))
           .join(F.broadcast(frequent.select("term")), "term", "left_anti").join(rare, "term"))
    pairs = stored(met.join(whose.join(holders, "entity"), "rid").where(F.col("n_term") <= limit(F.col("n_entity"))))
    information = F.log2(F.lit(float(total)) / F.col("n_entity"))
    pmi = F.log2(F.col("n_both") * F.lit(float(total)) / (F.col("n_entity") * F.col("n_term")))
    telling = (pairs.groupBy("entity", "term", "n_entity", "n_term").agg(F.count(F.lit(1)).alias("n_both"))
               .withColumn("disclosure", F.try_divide(pmi, information)).where(F.col("disclosure") >= generalise)
               .select("entity", "term", "disclosure"))
    best = (pairs.select("rid", "entity", "term").join(telling, ["entity", "term"])
            .groupBy("rid", "term").agg(F.max("disclosure").alias("disclosure")))
    places = held.select("rid", F.explode("words").alias("w")).select("rid", "w.*").join(best, ["rid", "term"])
    terms = places.groupBy(F.col("rid").alias("_rid")).agg(
        F.array_sort(F.collect_list(F.struct("start", "stop", "disclosure"))).alias("terms"))
    none = F.array().cast("array<struct<start:int,stop:int,disclosure:double>>")
    plain = rows.where(F.size("base") == 0).select("doc_id", "dk", "base", none.alias("terms"))
    marked = held.select("rid", "doc_id", "dk", "base").join(terms, F.col("rid") == F.col("_rid"), "left").select(
        "doc_id", "dk", "base", F.coalesce("terms", none).alias("terms"))
    return plain.unionAll(marked)


def report(docs: DataFrame, generalise: float = GENERALISE) -> DataFrame:
    """doc_id, a count per kind, base_sha256 (of kind:start:end of the matches) and spans (matches and terms)."""
    found = find(docs, generalise)

    def span(kind: Column, s: Column) -> Column:
        return F.struct(kind.alias("kind"), s["start"].alias("start"), s["stop"].alias("stop"))

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda e: e["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    every = F.concat(F.transform("base", lambda e: span(e["kind"], e)),
                     F.transform("terms", lambda t: span(F.lit("term"), t)))
    counts = map(count, KINDS)
    return found.select("doc_id", *counts, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
                        _joined(every).alias("spans"), F.size("terms").cast("bigint").alias("n_term"))


def sanitise(docs: DataFrame, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """``docs`` with entities replaced by their kind in brackets, telling terms by [NAME] (written with a
    capital) or [TERM], and the most telling ones left out. Overlapping spans go to the earliest."""
    found = find(docs, generalise).where("size(base) > 0").groupBy("doc_id", "dk").agg(
        F.first("base").alias("_base"), F.first("terms").alias("_terms"))
    found = found.withColumnsRenamed({"doc_id": "_id", "dk": "_dk"})
    text = F.col("row.text").cast("string")
    both = packed(docs).join(found, F.col("row.doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64(text) == F.col("_dk")), "left")
    capital = lambda t: F.substring(text, t["start"] + 1, F.lit(1)).rlike(r"\p{Lu}")
    marks = F.array_sort(F.concat(
        F.transform("_base", lambda e: F.struct(e["start"].alias("start"), e["stop"].alias("stop"),
                                                F.concat(F.lit("["), F.upper(e["kind"]), F.lit("]")).alias("mark"))),
        F.transform("_terms", lambda t: F.struct(
            t["start"].alias("start"), t["stop"].alias("stop"), F.when(t["disclosure"] >= remove, F.lit(""))
            .otherwise(F.when(capital(t), F.lit("[NAME]")).otherwise(F.lit("[TERM]"))).alias("mark")))))
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc, m):
        gap = F.substring(text, acc["at"] + 1, m["start"] - acc["at"])
        return F.when(m["start"] >= acc["at"], F.struct(
            m["stop"].alias("at"), F.concat(acc["out"], gap, m["mark"]).alias("out"))).otherwise(acc)

    clean = F.aggregate(marks, begin, step, lambda acc: F.concat(acc["out"], F.substring(
        text, acc["at"] + 1, F.char_length(text))))
    return both.select(*[F.when(F.col("_base").isNull(), text).otherwise(clean).alias("text") if c == "text"
                         else F.col(f"row.`{c}`") for c in docs.columns])
