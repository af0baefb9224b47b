"""Quality rules: distribution divergence from language references.

A document's histograms over character classes and over its language's common words are compared with that
language's references by the Jensen-Shannon distance. The references are the sums over all documents of the
language that pass the base rules, so no constant stands for a language's statistics. Every value of lang has a
reference for character classes, null too; common words are compared for the languages of COMMON alone. Texts below a minimum
length are not compared: a histogram of few words is far from any reference by chance alone. Built-in column
functions only.

The greatest distances allowed, MOST_CLASS and MOST_COMMON, lie above those of labelled good texts of 100 words or more
(at sf0.01 no greater than 0.146 for classes and 0.235 for common words, at sf0.1 0.201 and 0.246), and below those of
most labelled bad ones that pass the base rules (median for classes 0.317; 8 % of these are kept at sf0.01).

Each text is read once. Its counts go to a small table in the shared folder, from which both the references
(one row for each language, broadcast if there are no more than MOST_LANGUAGES) and the verdicts are taken.

Defined results: a null text counts like an empty one (no words, base_failed). A language none of whose documents passes
the base rules has no reference, which none of its documents needs. Repeated rows are judged alike, an empty table
gives an empty result, and extra columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecloom.llm.common import BLANKS, ascii_lower, let, small, written

SPLIT = r"[\x20\x09-\x0D]+"
#: Character classes, taken out of the text one after another; what is left is punctuation and symbols.
CLASSES = ("[a-z]+", "[A-Z]+", SPLIT, "[0-9]+", r"[^\x00-\x7F]+")
SYMBOLS = "#*$%&|<>"
#: Common function words of each language; fixed values.
COMMON = {
    "de": "als auf das dem den der des die ein eine in ist mit nicht und von",
    "en": "a and as be by for from in is it of on that the this to",
    "es": "a con de del el en es la las los para por que se un y",
    "fr": "de des du en est et la le les par pour que qui sur un une",
}
#: Least words, and greatest distance of the classes' and of the common words' histograms.
LEAST_WORDS, MOST_CLASS, MOST_COMMON = 100, 0.25, 0.30
BASE_WORDS = 50
#: Languages whose references are broadcast.
MOST_LANGUAGES = 10_000
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _repeated(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more. Hashes of 64 bits stand for windows. Most texts
    repeat none, which a hash set tells; the others sort their windows and merge what they cover."""

    def covered(hashes: Column) -> Column:
        def of_sorted(s: Column) -> Column:
            twice = F.filter(s, lambda x, i: F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False)))
            at = F.sort_array(F.transform(twice, lambda x: x["i"]))
            start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("stop"))
            return F.aggregate(at, start, lambda acc, i: F.struct((acc["n"] + i + 3 - F.greatest(i, acc["stop"])).alias("n"), (i + 3).alias("stop")), lambda acc: acc["n"])

        located = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(located, of_sorted))

    def of_words(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
        return F.when(F.size(w) < 4, F.lit(0)).otherwise(let(hashes, covered))

    return let(words, of_words)


def _common(plain: Column, lang: Column) -> Column:
    """Occurrences of each of the language's common words in a text whose words stand between blanks of their
    own, found by what replacing them takes away; null for other languages."""
    lists = F.create_map(*[x for k, v in COMMON.items() for x in (F.lit(k), F.array(*map(F.lit, v.split())))])
    words = F.try_element_at(lists, F.coalesce(lang, F.lit("")))
    return let(plain, lambda t: F.transform(words, lambda w: ((F.octet_length(t) - F.octet_length(F.replace(t, F.concat(F.lit(" "), w, F.lit(" ")), F.lit("")))) / (F.octet_length(w) + 2)).cast("long")))


def text_counts(docs: DataFrame) -> DataFrame:
    """doc_id, lang, the base counts, classes (characters of each class) and common (common words, then others)."""
    df = docs.select("doc_id", "lang", F.coalesce("text", F.lit("")).alias("t0"))
    for i, pattern in enumerate(CLASSES):
        df = df.withColumn(f"t{i + 1}", F.regexp_replace(f"t{i}", pattern, ""))
    last = len(CLASSES)
    size = [F.length(f"t{i}") - F.length(f"t{i + 1}") for i in range(last)] + [F.length(f"t{last}")]
    trimmed = F.btrim("t0", F.lit(BLANKS))
    plain = F.concat(F.lit(" "), F.regexp_replace(ascii_lower(F.col("t0")), r"[^a-z0-9\x{80}-\x{10FFFF}]+", "  "), F.lit(" "))
    lines = F.filter(F.split("t0", "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    df = df.select(
        "doc_id",
        "lang",
        F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPLIT)).alias("words"),
        (F.length("t0") - size[2]).cast("long").alias("word_chars"),
        (F.length(f"t{last}") - F.length(F.translate(f"t{last}", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        F.array(*(x.cast("long") for x in size)).alias("classes"),
        _common(plain, F.col("lang")).alias("listed"),
    )
    total = F.aggregate("listed", F.lit(0).cast("long"), lambda a, x: a + x)
    return df.select("doc_id", "lang", F.size("words").cast("long").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", _repeated(F.col("words")).cast("long").alias("n_repeat_words"), "classes", F.concat("listed", F.array(F.greatest(F.size("words") - total, F.lit(0)))).alias("common"))


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance, to base 2, of two arrays of counts; null if either sums to nothing."""

    def share(x: Column) -> Column:
        return let(F.aggregate(x, F.lit(0.0), lambda a, v: a + v), lambda s: F.when(s > 0, F.transform(x, lambda v: v / s)))

    def part(a: Column, b: Column) -> Column:
        return F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(0.0)

    terms = let(share(p), lambda a: let(share(q), lambda b: F.zip_with(a, b, lambda x, y: (part(x, y) + part(y, x)) / 2)))
    return F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda a, v: a + v), F.lit(0.0)))


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, lang, the base counts, base_failed, the two distances (null where not compared) and kept."""
    failed = (F.col("n_words") < BASE_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    counts = written(text_counts(docs).withColumn("base_failed", failed))
    sums = {"classes": len(CLASSES) + 1, "common": 1 + len(next(iter(COMMON.values())).split())}
    reference = counts.where(~F.col("base_failed")).groupBy(F.col("lang").alias("of")).agg(*(F.array(*(F.sum(F.get(c, F.lit(i))) for i in range(n))).alias(f"ref_{c}") for c, n in sums.items()))
    df = counts.join(small(reference, MOST_LANGUAGES), F.col("lang").eqNullSafe(F.col("of")), "left")
    long_enough = F.col("n_words") >= LEAST_WORDS
    df = df.withColumns({f"d_{c}": F.when(long_enough, js_distance(F.col(c), F.col(f"ref_{c}"))) for c in sums})
    far = (F.coalesce("d_classes", F.lit(0.0)) > MOST_CLASS) | (F.coalesce("d_common", F.lit(0.0)) > MOST_COMMON)
    return df.select("doc_id", "lang", *_COUNTS, "base_failed", "d_classes", "d_common", (~F.col("base_failed") & ~far).alias("kept"))


def op9_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "text")
    return judge(docs).select("doc_id", *_COUNTS, "base_failed", "kept")


def _op9_sql() -> str:
    blank, lists = r"\x20\x09-\x0D", ", ".join(f"('{k}', ['{"', '".join(v.split())}'])" for k, v in COMMON.items())
    classes = ["[a-z]", "[A-Z]", f"[{blank}]", "[0-9]", r"[^\x00-\x7F]"]
    sizes = ", ".join(f"length(t) - length(regexp_replace(t, '{c}', '', 'g'))" for c in classes)
    dist = """sqrt(greatest(0, list_sum(list_transform(range(1, len({a}) + 1), lambda i:
        ((CASE WHEN {a}[i] > 0 THEN {a}[i] / list_sum({a}) * log2(2 * ({a}[i] / list_sum({a})) / ({a}[i] / list_sum({a}) + {b}[i] / list_sum({b}))) ELSE 0 END) +
         (CASE WHEN {b}[i] > 0 THEN {b}[i] / list_sum({b}) * log2(2 * ({b}[i] / list_sum({b})) / ({a}[i] / list_sum({a}) + {b}[i] / list_sum({b}))) ELSE 0 END)) / 2))))"""
    return f"""
WITH lists(lang, words) AS (VALUES {lists}),
d AS (SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^{blank}]+') AS words,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^{blank}]')) AS lines,
        regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9\\x{{80}}-\\x{{10FFFF}}]+') AS plain FROM d),
x AS (SELECT rid, unnest(list_transform(range(1, len(words) - 1), lambda i: {{'i': i, 'g': words[i] || ' ' || words[i + 1] || ' ' || words[i + 2]}}), recursive := true) FROM w WHERE len(words) > 3),
g AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM x),
r AS (SELECT rid, count(DISTINCT p) AS n_repeat FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM g WHERE n > 1) GROUP BY rid),
c AS (SELECT rid, doc_id, w.lang, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
        (length(t) - length(regexp_replace(t, '[{SYMBOLS}]', '', 'g')))::BIGINT AS n_symbols,
        (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n_repeat, 0)::BIGINT AS n_repeat_words,
        [{sizes}, length(regexp_replace(t, '[a-zA-Z0-9{blank}]|[^\\x00-\\x7F]', '', 'g'))]::DOUBLE[] AS cls,
        list_transform(l.words_, lambda v: len(list_filter(plain, lambda p: p = v))) AS listed
      FROM w LEFT JOIN r USING (rid) LEFT JOIN (SELECT lang, words AS words_ FROM lists) l ON w.lang = l.lang),
f AS (SELECT *, (n_words < {BASE_WORDS} OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
        list_append(listed, greatest(n_words - list_sum(listed), 0))::DOUBLE[] AS com FROM c),
s AS (SELECT lang, [{", ".join(f"sum(cls[{i + 1}])" for i in range(len(CLASSES) + 1))}]::DOUBLE[] AS rcls,
        [{", ".join(f"sum(com[{i + 1}])" for i in range(1 + len(COMMON["en"].split())))}]::DOUBLE[] AS rcom
      FROM f WHERE NOT base_failed GROUP BY lang),
j AS (SELECT f.*, {dist.format(a="cls", b="rcls")} AS d_classes, CASE WHEN listed IS NOT NULL THEN {dist.format(a="com", b="rcom")} END AS d_common FROM f LEFT JOIN s ON f.lang IS NOT DISTINCT FROM s.lang)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND (n_words < {LEAST_WORDS} OR (coalesce(d_classes, 0) <= {MOST_CLASS} AND coalesce(d_common, 0) <= {MOST_COMMON})) AS kept FROM j
"""


OP9_SQL = _op9_sql()
