"""Articles of legal texts: where they begin and end, without the noise of scans between acts.

Everything happens in a document's own row until its articles are exploded:
nothing is shuffled. Only numbers and lengths of headers go to Python, where one
pass finds each article's end.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from ..functions import text as tx
from ..rules import fr_articles as fr
from . import acts

LEAST, SHORT = 10, 120  # characters of an article, and of one that may have been cut
WINDOWS = ((900, 700), (1700, 1300), (2500, 1800))  # characters before and behind a cut article that are searched for its rest
TAIL, PREFIX, CLAUSES = 480, 900, 3  # what is taken from before a header: characters, from where, clauses


def _next_plausible(numbers: list[int | None]) -> list[int]:
    """Index of the next header that ends each: the first without a number or with one not below its own; ``len`` if none."""
    out, later = [0] * len(numbers), []
    for i in range(len(numbers) - 1, -1, -1):
        n = numbers[i]
        while n is not None and later and numbers[later[-1]] is not None and numbers[later[-1]] < n:
            later.pop()
        out[i] = later[-1] if later else len(numbers)
        if n is None:
            later.clear()
        later.append(i)
    return out


@F.pandas_udf(ArrayType(StructType([StructField("start", IntegerType()), StructField("last", IntegerType())])))
def _spans(heads: pd.Series) -> pd.Series:
    """Of each part its start and the index of the part after its article; parts are ``(number, length)``, the first may be no header."""

    def one(parts: list[dict]) -> list[dict]:
        starts, at = [], 0
        for p in parts:
            starts.append(at)
            at += p["length"]
        ends = _next_plausible([None if p["number"] is None else int(p["number"]) for p in parts])
        return [{"start": s, "last": e} for s, e in zip(starts, ends, strict=True)]

    return heads.map(lambda x: None if x is None else one(x))


def article_spans(docs: DataFrame, keys: list[str], text: str = "text", around: bool = False, outer: bool = False) -> DataFrame:
    """SG3, SG4: ``keys, article_no, header, number, start_char, chars, text`` of each article of a text; with ``around`` also what stands ``before`` and in and ``behind`` it, as far as the windows reach.

    A header is a name or a bare number at a line's start, or a name with a dash
    anywhere. Its article ends at the next header whose number is not lower (a
    number that falls back is a reference within it, and a short article of its
    own), and at an annex. What stands before the first header belongs to no
    article. A text without headers, or null, gives no row, with ``outer`` one of nulls.
    """
    d = docs.select(*keys, F.coalesce(text, F.lit("")).alias("whole")).withColumn("parts", F.split("whole", fr.BEFORE_HEADER))
    reach, beyond = WINDOWS[-1]
    header = lambda p: F.regexp_extract(p, fr.HEADER, 0)
    d = d.withColumn("heads", F.transform("parts", lambda p: F.struct(F.regexp_extract(header(p), r"(\d+)", 1).try_cast("int").alias("number"), F.length(p).alias("length"), F.trim(header(p)).alias("header"))))
    d = d.withColumn("spans", _spans(F.transform("heads", lambda h: F.struct(h["number"], h["length"]))))

    def article(span: Column, i: Column) -> Column:
        return tx.once(F.regexp_replace(F.array_join(F.slice("parts", i + 1, F.get("spans", i)["last"] - i), ""), fr.ANNEX, ""), lambda whole: of(span, F.get("heads", i), whole))

    def of(span: Column, head: Column, whole: Column) -> Column:
        body = F.regexp_replace(F.substring(whole, F.length(F.regexp_extract(whole, fr.HEADER, 0)) + 1, F.length(whole)), r"(?U)^\s+|\s+$", "")
        near = []
        if around:
            first = F.greatest(span["start"] - reach, F.lit(0))
            near = [F.substring("whole", first + 1, span["start"] - first).alias("before"), F.substring("whole", span["start"] + 1, F.length(whole) + beyond).alias("behind")]
        return F.struct(*near, head["header"].alias("header"), head["number"].alias("number"), span["start"].alias("start_char"), F.length(whole).alias("chars"), F.btrim(F.concat(head["header"], F.lit("\n"), body), F.lit("\n ")).alias("text"))

    d = d.select(*keys, F.filter(F.transform("spans", article), lambda a: a["header"] != "").alias("articles"))
    # outer: without it a test for empty arrays goes below all these steps, each copied into it
    a = d.select(*keys, F.posexplode_outer("articles").alias("article_no", "a"))
    return (a if outer else a.filter("a IS NOT NULL")).select(*keys, (F.col("article_no") + 1).alias("article_no"), "a.*")


def _normal(x: Column) -> Column:
    # replaced one by one: texts without a sign are not copied for it
    for a, b in (("\u00a0", " "), ("\u00ad", ""), ("\ufffe", "")):
        x = F.replace(x, F.lit(a), F.lit(b))
    for pattern, to in (tx.BLANKS, (r"\n{3,}", "\n\n")):
        x = F.regexp_replace(x, pattern, to)
    return tx.stripped(x)


def clauses(x: str | Column) -> Column:
    return F.filter(F.transform(F.split(x, fr.CLAUSE), _normal), lambda c: c != "")


def _words(x: Column) -> Column:
    return F.array_except(F.array_distinct(F.regexp_extract_all(F.lower(x), F.lit(fr.WORD), F.lit(0))), F.array(*map(F.lit, fr.COMMON_WORDS)))


def until_signature(x: str | Column) -> Column:
    """SG4: a text's lines up to a signature or another act, without page headers; recalled texts (``vu``) behind the fourth line are left out."""
    out = tx.replaced_where(_normal(F.col(x) if isinstance(x, str) else x), [(p, "\n", w) for p, w in zip(fr.HARD_BREAKS, fr.HARD_BREAK_WORDS, strict=True)])
    lines = F.split(F.regexp_replace(out, r"\n{3,}", "\n\n"), "\n")
    marked = F.transform(lines, lambda t, i: F.struct(F.rtrim(t).alias("t"), (F.trim(t) == "") | t.rlike(fr.PAGE) | (t.rlike(fr.VISA) & (i > 3)), (i > 0) & t.rlike(fr.END)))
    marked = F.transform(marked, lambda m: F.struct(m["t"].alias("t"), m["col2"].alias("out"), (m["col3"] & ~m["col2"]).alias("end")))
    until = lambda m, end: F.slice(m, F.lit(1), F.when(end > 0, end - 1).otherwise(F.size(m)))
    ended = lambda m: tx.once(F.array_position(F.transform(m, lambda x: x["end"]), F.lit(True)).cast("int"), lambda end: until(m, end))
    kept = F.filter(tx.once(marked, ended), lambda m: ~m["out"])
    return F.btrim(F.array_join(F.transform(kept, lambda m: m["t"]), "\n"), F.lit("\n "))


def pruned(df: DataFrame, column: str) -> DataFrame:
    """SG4: ``column`` without what two acts leave in each other: bridges, clauses of the gazette, titles that share no word with the first two clauses, and scraps, unless they hold a word of a rule."""
    compact = _normal(tx.replaced_where(_normal(F.col(column)), [(fr.BRIDGE, " ", fr.BRIDGE_WORDS), (r"(?U)\s{2,}", " ", ())]))
    df = df.withColumn("_compact", compact).withColumn("_clauses", clauses("_compact"))
    # whether any clause may be one of the gazette or a title: what a clause holds, the whole holds
    df = df.withColumn("_titles", tx.may_match(F.col("_compact"), fr.ACT_WORDS)).withColumn("_gazette", tx.may_match(F.col("_compact"), fr.GAZETTE_WORDS) | F.col("_compact").rlike(fr.NUMBERED_ISSUE))
    df = df.withColumn("_anchor", F.when(F.col("_titles"), _words(F.array_join(F.slice("_clauses", 1, 2), " "))))

    def stays(c: Column, i: Column) -> Column:
        foreign = F.col("_titles") & c.rlike(fr.ACT_TITLE) & (F.size(F.array_intersect(_words(c), F.col("_anchor"))) == 0)
        # the long pattern of rules last: few clauses come to it
        return ~(((i > 0) & (F.length(c) < 24)) | (F.col("_gazette") & c.rlike(fr.GAZETTE)) | ((i > 0) & foreign)) | c.rlike(fr.NORMATIVE)

    kept = F.array_join(F.filter("_clauses", stays), " ")
    return df.withColumn(column, F.when(F.size("_clauses") <= 1, F.col("_compact")).otherwise(tx.once(kept, lambda k: F.when(k == "", F.col("_compact")).otherwise(F.trim(k))))).drop("_compact", "_clauses", "_anchor", "_titles", "_gazette")


def longest_heading(x: str | Column) -> Column:
    """SG4: of a text with several headings the longest stretch from one to the next, if it has 180 characters; else the text."""
    x = F.col(x) if isinstance(x, str) else x
    stretches = F.split(F.regexp_replace(x, fr.MAJOR_HEADING, "\u0001$0"), "\u0001")
    rated = F.transform(F.slice(stretches, F.lit(2), F.greatest(F.size(stretches) - 2, F.lit(0))), lambda s, i: F.struct(F.length(F.trim(s)).alias("n"), F.regexp_count(s, F.lit(fr.NORMATIVE)).alias("rules"), (-i).alias("i"), F.trim(s).alias("s")))
    best = F.array_max(rated)
    return F.when(tx.may_match(x, fr.HEADING_WORDS) & (best["n"] >= 180), best["s"]).otherwise(x)


def trimmed(df: DataFrame, column: str = "text") -> DataFrame:
    """SG4: ``column`` up to a signature, sanitised to one line, without noise between acts, within one heading."""
    df = df.withColumn(column, tx.sanitize(until_signature(column)))
    return pruned(df, column).withColumn(column, longest_heading(column))


def cut_off(x: Column) -> Column:
    """SG4: short, or open at its end."""
    return (x != "") & ((F.length(x) < SHORT) | (~x.rlike(fr.SENTENCE_END) & x.rlike(fr.OPEN_END)))


def _code(x: Column) -> Column:
    """Code of a header: ST9's, or the number of a bare one."""
    return F.coalesce(F.nullif(tx.article_code(x), F.lit("")), F.regexp_extract(x, r"(\d+)", 1))


def _other(piece: Column, code: Column) -> Column:
    head = F.regexp_extract(piece, fr.HEADER, 0)
    return (head != "") & (_code(head) != code)


def _before_other(x: Column, code: Column) -> Column:
    """A text up to the first header of another article behind its first 120 characters."""
    start = F.struct(F.lit(False).alias("done"), F.lit("").alias("s"))
    add = lambda a, p: F.when(a["done"], a).when((F.length(a["s"]) >= SHORT) & _other(p, code), F.struct(F.lit(True).alias("done"), a["s"].alias("s"))).otherwise(F.struct(F.lit(False).alias("done"), F.concat(a["s"], p).alias("s")))
    return F.trim(F.aggregate(F.split(x, fr.BEFORE_HEADER), start, add)["s"])


def _rating(x: Column, code: Column) -> Column:
    """How whole an article looks: words of repair and rule, an end, its length, less noise and other articles' headers."""
    n = lambda p: F.regexp_count(x, F.lit(p))
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("n"))
    add = lambda a, p: F.struct((a["at"] + F.length(p)).alias("at"), (a["n"] + F.when((a["at"] >= SHORT) & _other(p, code), 1).otherwise(0)).alias("n"))
    others = F.aggregate(F.split(x, fr.BEFORE_HEADER), start, add)["n"]
    return 8 * n(fr.REPAIR) + 4 * n(fr.NORMATIVE) + F.when(x.rlike(fr.SENTENCE_END), 2).otherwise(0) + F.least(F.lit(16), F.floor(F.length(x) / 120).cast("int")) - 5 * n(fr.GAZETTE) - 6 * others


def _clauses_before(prefix: Column) -> Column:
    """The last clauses of a rule before a header: three at most, none behind 480 characters, no headers."""
    takes = lambda c: (c.rlike(fr.NORMATIVE) | c.rlike(fr.REPAIR)) & (F.size(F.split(c, fr.BEFORE_HEADER)) == 1) & ~c.rlike(fr.HEADER) & ~c.rlike(r"(?i)^\s*(?:art\.?\s*)?\d+\s*[-:]")
    last = F.slice(F.reverse(F.filter(clauses(prefix), takes)), 1, CLAUSES)
    kept = lambda x: F.filter(x, lambda c, i: F.aggregate(F.slice(x, F.lit(1), i), F.lit(0), lambda n, y: n + F.length(y)) < TAIL)
    # as an element, so that the clauses are read once
    return F.get(F.transform(F.array(last), lambda x: F.array_join(F.reverse(kept(x)), " ")), F.lit(0))


def repaired(df: DataFrame) -> DataFrame:
    """SG4: ``text`` of a cut article completed from its surroundings (``before, behind, header, chars``), where that rates clearly higher.

    Each window around it is cleaned; what follows its header there is taken, led
    by the clauses of a rule just before it if the rest is short or no legal
    start, up to another article's header, and trimmed.
    """
    df = df.withColumn("_base", _normal(F.col("text"))).withColumn("_code", _code(F.col("header"))).withColumn("_cut", cut_off(F.col("_base")))
    last = F.lit("")
    best = [F.struct(_rating(F.col("_base"), F.col("_code")).alias("rating"), F.length("_base").alias("n"), F.lit(0).alias("i"), F.col("_base").alias("s"))]
    for i, (left, right) in enumerate(WINDOWS, 1):
        w = f"_w{i}"
        reach = F.concat(F.right("before", F.lit(left)), F.substring("behind", F.lit(1), F.col("chars") + right))
        # a window that reaches no further than the one before gives what that gives: the text ends there
        df = df.withColumn(f"_reach{i}", F.when(F.col("_cut"), reach)).withColumn(w, F.when(F.col("_cut") & (F.col(f"_reach{i}") != last), _normal(F.col(f"_reach{i}"))))
        last = F.col(f"_reach{i}")
        df = pruned(df.withColumn(w, F.when(F.length(w) >= F.length("_base") + 40, tx.sanitize(w))), w)
        df = df.withColumn("_at", F.instr(F.lower(w), F.lower("header")))
        df = df.withColumn("_tail", F.when(F.col("_at") > 0, _clauses_before(F.right(F.substring(w, F.lit(1), F.col("_at") - 1), F.lit(PREFIX)))))
        df = df.withColumn("_rest", F.when(F.col("_at") > 0, F.substring(w, F.col("_at") + F.length("header"), F.length(w))).otherwise(F.col(w)))
        head = _normal(F.substring("_rest", 1, 260))
        led = (F.col("_tail") != "") & ((F.length(head) < SHORT) | ~head.rlike(fr.LEGAL_START))
        body = _normal(F.when(led, F.concat("_tail", F.lit(" "), "_rest")).otherwise(F.col("_rest")))
        df = df.withColumn(w, F.when(F.col(w) != "", _before_other(_normal(F.concat("header", F.lit("\n"), body)), F.col("_code"))))
        df = trimmed(df, w)
        c = F.col(w)
        best.append(F.when(F.col("_cut") & (c != "") & (F.length(c) >= F.length("_base")), F.struct(_rating(c, F.col("_code")).alias("rating"), F.length(c).alias("n"), F.lit(-i).alias("i"), c.alias("s"))))
    df = df.withColumn("_all", F.when(F.col("_cut"), F.array(*best))).withColumn("_best", F.array_max("_all")).withColumn("_own", F.get("_all", F.lit(0)))
    own, top = F.col("_own"), F.col("_best")
    better = ((top["rating"] >= own["rating"] + 3) & (top["n"] >= own["n"] + 40)) | ((top["n"] >= own["n"] + 120) & (top["rating"] >= own["rating"]))
    # not deterministic on purpose: a filter on the text is not pushed below all these steps, each copied into it
    text = F.when(F.monotonically_increasing_id() >= 0, F.when(F.col("_cut") & better, top["s"]).otherwise(F.col("_base")))
    return df.withColumn("text", text).drop("_base", "_code", "_cut", "_at", "_tail", "_rest", "_all", "_best", "_own", *[f"_{x}{i}" for i in range(1, len(WINDOWS) + 1) for x in ("w", "reach")])


def articles(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """SG2, SG3, SG4, SG6: ``key, act_title, article_no, header, number, start_char, text`` of each document's articles.

    Acts that only appoint persons are left out; articles are trimmed, cut ones repaired; what has
    fewer than ten characters is dropped. A document without any header (or only
    with such acts) is one article, ``Document``, as it is; a null text is empty.
    """
    headed = lambda t: t.rlike(fr.HEADER) | (F.size(F.split(t, fr.BEFORE_HEADER)) > 1)
    d = docs.select(key, F.coalesce(text, F.lit("")).alias("_whole")).withColumn("_acts", acts.split_acts("_whole"))
    d = d.withColumn("_acts", F.filter("_acts", lambda a: headed(a["text"]) & ~acts.individual(a["title"], a["text"])))
    # documents that stay whole go along, as rows without an act: as a branch of their own they would split all texts again, before they are dealt out
    a = d.select(key, F.when(F.size("_acts") == 0, F.col("_whole")).alias("_whole"), F.explode_outer("_acts").alias("a")).select(key, "_whole", F.col("a.title").alias("act_title"), F.col("a.start").alias("_from"), F.col("a.text").alias("_act"))
    x = repaired(trimmed(article_spans(a, [key, "_whole", "act_title", "_from"], "_act", around=True, outer=True)))
    x = x.filter(F.col("_whole").isNotNull() | ((F.length("text") >= LEAST) & F.col("header").isNotNull()))
    own = lambda value, other: F.when(F.col("_whole").isNotNull(), value).otherwise(other)
    document = F.lit("Document")
    return x.select(key, own(document, F.col("act_title")).alias("act_title"), own(F.lit(1), F.col("article_no")).alias("article_no"), own(document, F.col("header")).alias("header"), "number", own(F.lit(0), F.col("_from") + F.col("start_char")).alias("start_char"), own(F.col("_whole"), F.col("text")).alias("text"))
