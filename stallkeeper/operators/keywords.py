"""Words and word pairs of one-star texts per category."""
from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import Column, DataFrame, functions as F

from stallkeeper.operators.category import satisfaction

# Portuguese stop words, accents removed.
STOP_WORDS = (
    "a", "ao", "aos", "aquela", "aquelas", "aquele", "aqueles", "aquilo", "as", "ate", "com", "como", "da", "das",
    "de", "dela", "delas", "dele", "deles", "depois", "do", "dos", "e", "ela", "elas", "ele", "eles", "em", "entre",
    "era", "eram", "essa", "essas", "esse", "esses", "esta", "estao", "estas", "estava", "estavam", "este", "estes",
    "eu", "foi", "foram", "ha", "isso", "isto", "ja", "mais", "mas", "me", "mesmo", "meu", "meus", "minha",
    "minhas", "muito", "na", "nao", "nas", "nem", "no", "nos", "nossa", "nossas", "nosso", "nossos", "num", "numa",
    "o", "os", "ou", "para", "pela", "pelas", "pelo", "pelos", "por", "porque", "que", "quem", "se", "sem", "ser",
    "seu", "seus", "so", "sua", "suas", "tambem", "tem", "tendo", "tenho", "ter", "teve", "um", "uma", "umas",
    "uns", "voce", "voces")


def _folds() -> tuple[dict[str, str], dict[str, str], str]:
    """What compatibility decomposition makes of every character: those that become one plain letter, those that
    become several characters with a letter among them, and the class of combining marks, which vanish."""
    single, several, marks = {}, {}, []
    for code in (*range(0x80, 0xD800), *range(0xE000, sys.maxunicode + 1)):
        c = chr(code)
        if unicodedata.combining(c):
            if marks and marks[-1][1] == code - 1:
                marks[-1][1] = code
            else:
                marks.append([code, code])
            continue
        parts = unicodedata.normalize("NFKD", c)
        if parts != c:
            plain = "".join(x for x in parts if not unicodedata.combining(x))
            if any("a" <= x <= "z" for x in plain):
                (single if len(plain) == 1 else several)[c] = plain
    return single, several, "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in marks) + "]"


SINGLE, SEVERAL, MARKS = _folds()


#: Below this character no text needs more than a letter for a letter.
RARE = f"[\\x{{{min(min(map(ord, SEVERAL)), 0x300):x}}}-\\x{{10ffff}}]"  # combining marks begin at 300


def tokens(text: Column) -> Column:
    """Lower-case words of at least two letters, accents and other letter forms folded, stop words removed. Letters that
    become several are looked up one by one, and combining marks taken out, only in texts that hold a rare character."""
    low = F.lower(text)
    table = F.create_map(*[F.lit(x) for pair in SEVERAL.items() for x in pair])
    letters = F.transform(F.regexp_extract_all(low, F.lit("(?s)."), F.lit(0)), lambda c: F.coalesce(table[c], c))
    low = F.when(low.rlike(RARE), F.regexp_replace(F.array_join(letters, ""), MARKS, "")).otherwise(low)
    folded = F.translate(low, "".join(SINGLE), "".join(SINGLE.values()))
    words = F.split(F.regexp_replace(folded, "[^a-z]+", " "), " ")
    return F.filter(words, lambda w: (F.length(w) >= 2) & ~w.isin(*STOP_WORDS))


def negative_keywords(reviews: DataFrame, min_reviews: int = 30) -> DataFrame:
    """Unigram and bigram counts of the one-star texts of every eligible category.

    ``reviews`` has one row per order and category. Texts are cut into words as a whole and
    counted map-side, so neither a long text nor a dominant category gathers in one task.
    """
    stats = satisfaction(reviews, min_reviews).where("sample_status = 'eligible'").select(
        "category_name", "one_star_rate", "negative_text_review_orders")
    bad = reviews.where((F.col("review_score") == 1) & (F.trim("review_comment_message") != "")).select(
        "category_name", tokens(F.col("review_comment_message")).alias("t"))
    pair = F.zip_with(F.slice("t", 1, F.greatest(F.size("t") - 1, F.lit(0))),
                      F.slice("t", 2, F.greatest(F.size("t") - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    tag = lambda kind, words: F.transform(words, lambda w: F.struct(
        F.lit(kind).alias("keyword_type"), w.alias("keyword")))
    grams = bad.select("category_name", F.explode(F.concat(tag("unigram", F.col("t")), tag("bigram", pair))).alias("g"))
    counts = grams.groupBy("category_name", "g.keyword_type", "g.keyword").agg(F.count("*").alias("frequency"))
    return counts.join(stats, "category_name").select(
        "category_name", "keyword_type", "keyword", "frequency", "one_star_rate", "negative_text_review_orders")
