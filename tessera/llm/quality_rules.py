"""Quality rules: base counts and distribution divergence. DataFrame functions only.

A document's character-class histogram and its histogram over its language's common words are
compared with the language's references by Jensen-Shannon distance (base 2, 0 to 1). References are
the mean histograms of all documents of the language that pass the base rules and are long enough (or,
with ``trusted``, of those among them that are trusted: a corpus of mostly junk should not set its own
reference); ``languages`` bounds their number. A document too short for a histogram to mean anything is
not judged by it (minimum-length guards).

Base rules: fewer than 50 words, or over half of the words in repeated 3-word windows, reject.

Defined results: null or blank text has 0 words and fails; a very long text is measured whole; a
document of a null or unlisted language is compared with the nearest of all references, in classes and
in words; a language without a long document has no reference and its documents pass; a distance that
ties with the limit passes; repeated rows are judged alike; extra columns, whatever their names, are not
read and :func:`keep_good` returns them as they are; an empty table gives an empty result. Three-word
windows are found by sorting 64-bit keys inside the row (hash above, position below) and compared
word by word where keys agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, materialize

#: Common words of each language.
COMMON_WORDS = {
    "en": ["the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "as", "was", "with", "on", "by", "be"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "par"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "für", "ist", "im", "dem"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un", "por", "con", "una", "su"],
}
#: Character classes, each taken from what the ones before it leave.
CLASSES = {
    "consonants": "[b-df-hj-np-tv-z]+",
    "vowels": "[aeiou]+",
    "gaps": "[\\x20\\x09-\\x0D]+",
    "symbols": "[#*$%&|<>]+",
    "capitals": "[A-Z]+",
    "digits": "[0-9]+",
    "marks": "[.,;:!?'\"()-]+",
}
MIN_WORDS = 50
MIN_CHARS = 200
MIN_HISTOGRAM_WORDS = 100
MAX_CLASS_DISTANCE = 0.33
MAX_WORD_DISTANCE = 0.255


def all_words(languages: dict) -> list[str]:
    return sorted({w for v in languages.values() for w in v})


def features(docs: DataFrame, languages: dict = COMMON_WORDS, keep: tuple = ("doc_id",)) -> DataFrame:
    """``keep`` columns with lang, the base counts, ``chars`` (class counts) and ``common`` (word counts)."""
    text = docs.select(*keep, "lang", F.coalesce("text", F.lit("")).alias("r0"))
    for i, pattern in enumerate(CLASSES.values()):
        text = text.withColumn(f"r{i + 1}", F.regexp_replace(f"r{i}", pattern, ""))
    left = [F.length(f"r{i}") for i in range(len(CLASSES) + 1)]
    taken = dict(zip(CLASSES, [a - b for a, b in zip(left, left[1:], strict=False)], strict=True))
    lines = F.filter(F.split("r0", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    trimmed = F.trim("r0", F.lit(" \t\n\u000b\f\r"))
    counted = text.select(
        *keep, "lang", lines.alias("lines"),
        F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[\\x20\\x09-\\x0D]+")).alias("words"),
        (left[0] - taken["gaps"]).cast("long").alias("word_chars"), taken["symbols"].cast("long").alias("n_symbols"),
        F.array(*[x.cast("double") for x in [*taken.values(), left[-1]]]).alias("chars"),
    )
    lists = F.create_map(*[x for k, v in languages.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    every = F.array(*map(F.lit, all_words(languages)))
    known = F.col("lang").isin(*languages)
    words = counted.withColumns({
        "n_words": F.size("words").cast("long"),
        "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
        "bits": F.length(F.bin(F.size("words"))),
        "mine": F.when(known, F.element_at(lists, F.col("lang"))).otherwise(every),
        "seen": F.filter("words", lambda w: w.isin(*all_words(languages))),
    }).drop("lines")
    word = lambda i: F.get("words", i)
    window = lambda i: F.expr("0") if i is None else F.xxhash64(word(i), word(i + 1), word(i + 2))
    packed = lambda i: F.call_function("shiftleft", F.call_function("shiftright", window(i), F.col("bits")), F.col("bits")).bitwiseOR(i.cast("long"))
    keyed = words.withColumn("keys", F.when(F.col("n_words") < 3, F.array().cast("array<bigint>")).otherwise(F.sort_array(F.transform(F.sequence(F.lit(0), F.size("words") - 3), packed))))
    place = lambda k: F.get("keys", k).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bits")) - 1).cast("int")

    def again(k: Column) -> Column:
        same = F.call_function("shiftright", F.get("keys", k).bitwiseXOR(F.get("keys", k - 1)), F.col("bits")) == 0
        return same & (word(place(k)) == word(place(k - 1))) & (word(place(k) + 1) == word(place(k - 1) + 1)) & (word(place(k) + 2) == word(place(k - 1) + 2))

    twice = keyed.withColumn("twice", F.when(F.size("keys") < 2, F.array().cast("array<int>")).otherwise(F.filter(F.sequence(F.lit(1), F.size("keys") - 1), again)))
    at = twice.withColumn("at", F.sort_array(F.array_distinct(F.concat(F.transform("twice", place), F.transform("twice", lambda k: place(k - 1))))))
    start = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n"))
    covered = F.aggregate("at", start, lambda s, x: F.struct(x.alias("last"), (s["n"] + F.least(F.lit(3), x - s["last"])).alias("n")), lambda s: s["n"])
    common = F.transform("mine", lambda c: F.size(F.filter("seen", lambda w: w == c)).cast("double"))
    return at.select(*keep, "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", covered.cast("long").alias("n_repeat_words"), "chars", common.alias("common")).withColumn(
        "base_failed", (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    )


def shares(counts: Column) -> Column:
    """A histogram as shares of its sum (all 0 if that is 0)."""
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    return F.transform(counts, lambda x: F.when(total > 0, x / total).otherwise(F.lit(0.0)))


def fit_references(measured: DataFrame, languages: dict = COMMON_WORDS, trusted: Column | None = None) -> dict[str, dict[str, list[float]]]:
    """Mean histograms by listed language, of the ``trusted`` rows if that is given. Reads all documents; returns one small row a language, at most ``len(languages)``."""
    fit = measured.where(~F.col("base_failed") & F.col("lang").isin(*languages))
    fit = fit if trusted is None else fit.where(trusted)
    n = len(CLASSES) + 1
    parts = fit.select("lang", (F.aggregate("chars", F.lit(0.0), lambda a, x: a + x) >= MIN_CHARS).alias("c_ok"), (F.col("n_words") >= MIN_HISTOGRAM_WORDS).alias("w_ok"), shares(F.col("chars")).alias("c"), with_rest(F.col("common"), F.col("n_words")).alias("w"))
    size = max(len(v) for v in languages.values()) + 1
    rows = parts.groupBy("lang").agg(*[F.avg(F.when(F.col("c_ok"), F.get("c", F.lit(i)))).alias(f"c{i}") for i in range(n)], *[F.avg(F.when(F.col("w_ok"), F.get("w", F.lit(i)))).alias(f"w{i}") for i in range(size)]).collect()
    return {r["lang"]: {"chars": [r[f"c{i}"] for i in range(n)] if r["c0"] is not None else None, "words": [r[f"w{i}"] for i in range(len(languages[r["lang"]]) + 1)] if r["w0"] is not None else None} for r in rows}


def with_rest(common: Column, n_words: Column) -> Column:
    """Shares of the common words among all words, and of the rest."""
    total = F.aggregate(common, F.lit(0.0), lambda a, x: a + x)
    return F.transform(F.concat(common, F.array(n_words - total)), lambda x: F.when(n_words > 0, x / n_words).otherwise(F.lit(0.0)))


def js_distance(p: Column, q: list[float]) -> Column:
    """Jensen-Shannon distance of a share array and a reference, base 2."""
    half = lambda a, m: F.when(a > 0, a * F.log2(a / m)).otherwise(F.lit(0.0))
    reference = F.array(*[F.lit(float(x)) for x in q])
    sums = F.zip_with(p, reference, lambda a, b: half(a, (a + b) / 2) + half(b, (a + b) / 2))
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(sums, F.lit(0.0), lambda s, x: s + x) / 2))


def judge(measured: DataFrame, references: dict, max_class: float = MAX_CLASS_DISTANCE, max_word: float = MAX_WORD_DISTANCE) -> DataFrame:
    """Adds js_class, js_words (null: not judged) and kept."""

    def nearest(kind: str, p: Column, enough: Column) -> Column:
        known = {k: v[kind] for k, v in references.items() if v[kind]}
        if not known:
            return F.lit(None).cast("double")
        own = F.lit(None).cast("double")
        for k, q in known.items():
            own = F.when(F.col("lang") == k, js_distance(p, q)).otherwise(own)
        if kind == "words":  # counts of an unlisted language's document are of the words of all lists
            at = {w: i for i, w in enumerate(all_words(COMMON_WORDS))}
            every = [js_distance(with_rest(F.array(*[F.get("common", F.lit(at[w])) for w in COMMON_WORDS[k]]), F.col("n_words")), q) for k, q in known.items()]
        else:
            every = [js_distance(p, q) for q in known.values()]
        near = F.least(*every) if len(every) > 1 else every[0]
        return F.when(enough, F.when(F.col("lang").isin(*COMMON_WORDS), own).otherwise(near))

    enough = F.aggregate("chars", F.lit(0.0), lambda a, x: a + x) >= MIN_CHARS
    judged = measured.withColumns({
        "js_class": F.round(nearest("chars", shares(F.col("chars")), enough), 6),
        "js_words": F.round(nearest("words", with_rest(F.col("common"), F.col("n_words")), F.col("n_words") >= MIN_HISTOGRAM_WORDS), 6),
    })
    passed = (F.coalesce("js_class", F.lit(0.0)) <= max_class) & (F.coalesce("js_words", F.lit(0.0)) <= max_word)
    return judged.withColumn("kept", ~F.col("base_failed") & passed)


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, in the input's columns. Rows are measured once and written with their counts."""
    measured = materialize(features(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "lang", "text"), keep=("row",)), "quality-rows")
    return judge(measured, fit_references(measured)).where("kept").select(*[F.col(f"row.`{c}`") for c in docs.columns])


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = materialize(features(documents(spark, sf_dir)), "quality")
    return judge(measured, fit_references(measured)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "js_class", "js_words")


def op1_sql() -> str:
    """DuckDB SQL for :func:`op1_quality_rules`, generated from the same fixed values."""
    n, lists, langs = len(CLASSES) + 1, COMMON_WORDS, ", ".join(f"'{k}'" for k in COMMON_WORDS)
    quoted = lambda ws: "[" + ", ".join(f"'{w}'" for w in ws) + "]"
    chain, last = [], "text_"
    for i, pattern in enumerate(CLASSES.values()):
        chain.append(f"r{i + 1} as (select *, regexp_replace(r{i}, '{pattern.replace(chr(39), chr(39) * 2)}', '', 'g') as r{i + 1} from {last})")
        last = f"r{i + 1}"
    js = lambda p, q: f"sqrt(greatest(0, list_sum(list_transform(list_zip({p}, {q}), lambda z: (case when z[1] > 0 then z[1] * log2(z[1] / ((z[1] + z[2]) / 2)) else 0 end) + (case when z[2] > 0 then z[2] * log2(z[2] / ((z[1] + z[2]) / 2)) else 0 end))) / 2))"
    mean = lambda col, k, ok: "[" + ", ".join(f"avg({col}[{i + 1}]) filter (where {ok})" for i in range(k)) + "]"
    words = max(len(v) for v in lists.values()) + 1
    every = all_words(lists)
    at = "case r.lang " + " ".join(f"when '{k}' then {[every.index(w) + 1 for w in v]}" for k, v in lists.items()) + " end"
    share = "case when n_words > 0 then m.common[i] / n_words else 0 end"
    return f"""
with text_ as (
  select row_number() over () as rid, doc_id, lang, coalesce(text, '') as r0, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as lines from documents
), {", ".join(chain)}, windows as (
  select rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as g from (select rid, w, unnest(range(1, len(w) - 1)) as i from text_ where len(w) > 2)
), twice as (
  select rid, i from windows qualify count(*) over (partition by rid, g) > 1
), repeated as (
  select rid, count(distinct i + j) as n from twice, (values (0), (1), (2)) as o(j) group by rid
), counted as (
  select r.rid, doc_id, lang, cast(len(w) as bigint) as n_words, cast(length(r0) - length(r2) + length(r3) as bigint) as word_chars, cast(length(r3) - length(r4) as bigint) as n_symbols,
    cast(len(lines) - len(list_distinct(lines)) as bigint) as n_dup_lines, cast(coalesce(n, 0) as bigint) as n_repeat_words,
    [{", ".join(f"(length(r{i}) - length(r{i + 1}))::double" for i in range(n - 1))}, length(r{n - 1})::double] as chars,
    list_transform(case lang {" ".join(f"when '{k}' then {quoted(v)}" for k, v in lists.items())} else {quoted(every)} end, lambda c: len(list_filter(w, lambda x: x = c))::double) as common
  from {last} r left join repeated using (rid)
), measured as (
  select *, n_words < {MIN_WORDS} or 100 * n_repeat_words > 50 * n_words as base_failed,
    list_transform(chars, lambda x: case when list_sum(chars) > 0 then x / list_sum(chars) else 0 end) as cs,
    list_transform(list_append(common, n_words - coalesce(list_sum(common), 0)), lambda x: case when n_words > 0 then x / n_words else 0 end) as ws
  from counted
), refs as (
  select lang, {mean("cs", n, f"list_sum(chars) >= {MIN_CHARS}")} as rc, {mean("ws", words, f"n_words >= {MIN_HISTOGRAM_WORDS}")} as rw
  from measured where not base_failed and lang in ({langs}) group by lang
), near as (
  select m.rid, min({js("m.cs", "r.rc")}) as d, min({js(f"list_append(list_transform({at}, lambda i: {share}), case when n_words > 0 then (n_words - coalesce(list_sum(list_transform({at}, lambda i: m.common[i])), 0)) / n_words else 0 end)", "r.rw")}) as dw from measured m, refs r where m.lang is null or m.lang not in ({langs}) group by m.rid
), judged as (
  select m.*, round(case when list_sum(chars) >= {MIN_CHARS} then case when r.lang is null then near.d else {js("m.cs", "r.rc")} end end, 6) as js_class,
    round(case when n_words >= {MIN_HISTOGRAM_WORDS} then case when r.lang is null then near.dw else {js("m.ws", "r.rw")} end end, 6) as js_words
  from measured m left join refs r on m.lang = r.lang left join near on m.rid = near.rid
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and coalesce(js_class, 0) <= {MAX_CLASS_DISTANCE} and coalesce(js_words, 0) <= {MAX_WORD_DISTANCE} as kept, js_class, js_words
from judged
""".replace("\\\\", "\\")
