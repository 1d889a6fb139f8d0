"""Entities by patterns and gazetteer, keywords, key phrases and extractive summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import rules as R
from ..functions import text as T
from ..scratch import materialize, scratch

_MONTH = "(?:" + "|".join(R.MONTHS) + ")"
#: Label -> pattern; at one place the first label wins.
PATTERNS = {
    "DATE": rf"\d{{4}}-\d{{2}}(?:-\d{{2}})?|\d{{1,2}}(?:st|nd|rd|th)? {_MONTH} \d{{4}}|{_MONTH} \d{{1,2}},? \d{{4}}|{_MONTH} \d{{4}}|\b(?:19|20)\d{{2}}\b",
    "MONEY": r"[$€£]\s?\d[\d,.]*(?:\s?(?:bn|billion|million|m)\b)?|\d[\d,.]* (?:USD|INR|EUR)\b",
    "PERCENT": r"\d+(?:\.\d+)?(?: ?%| percent\b)",
    "CARDINAL": r"\b\d[\d,]*(?:\.\d+)?\b",
}
#: What all matches begin with, looked at first: at most other places no pattern is tried.
_BEGINS = rf"(?=[\d$€£]|[{''.join(sorted({m[0] for m in R.MONTHS}))}](?:{'|'.join(m[1:3] for m in R.MONTHS)}))"
_ANY = f"(?i){_BEGINS}(?:" + "|".join(f"(?:{p})" for p in PATTERNS.values()) + ")"
_TOKEN = r"[\p{L}\p{N}]+"


def _label(text: Column) -> Column:
    made = F.lit("CARDINAL")
    for label in reversed(PATTERNS):
        made = F.when(text.rlike(f"(?i)^(?:{PATTERNS[label]})$"), F.lit(label)).otherwise(made)
    return made


def _matches(text: Column, pattern: str) -> Column:
    """Struct of a pattern's matches m and of what stands before each, g."""
    found, between = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1)), F.split(text, pattern, -1)
    return T.once(found, lambda m: F.struct(m.alias("m"), F.slice(between, F.lit(1), F.size(m)).alias("g")))


def _ends(matches: Column) -> Column:
    """Where each match ends: matches and gaps alternate, so their lengths add up to the places."""
    return T.running_sums(F.zip_with(matches["g"], matches["m"], lambda g, m: F.length(g) + F.length(m)))


def _spans(text: Column, pattern: str) -> Column:
    """Array of (start, end, text) of a pattern's matches."""

    def of(x: Column) -> Column:
        return T.once(_ends(x), lambda ends: F.transform(x["m"], lambda m, i: F.struct((F.get(ends, i) - F.length(m)).alias("start"), F.get(ends, i).alias("end"), m.alias("text"))))

    return T.once(_matches(text, pattern), of)


def pattern_entities(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, label, start, end) of dates, money, percentages and numbers; offsets in characters, end exclusive. Narrow."""
    found = df.select(id_col, F.explode(_spans(F.col(text_col), _ANY)).alias("e"))
    return found.select(id_col, F.col("e.text").alias("text"), _label(F.col("e.text")).alias("label"), F.col("e.start").cast("long").alias("start"), F.col("e.end").cast("long").alias("end"))


#: Words that a place carries along; longer names go on from the place where they end.
AHEAD = 4


def name_trie(gazetteer: DataFrame) -> DataFrame:
    """(node, piece, child, label, more, words): the names (name, label) as a trie. A step takes the first word, or what stands
    before the next word with it, in lower case; label is set where a name ends, more where a longer one goes on, and
    words is the number of words of the longest name through the step. Signs at the ends of a name don't count.

    A node is the MD5 of the steps to it, so the table is made row by row from the names, and a step that many names
    share is one row.
    """
    key = F.regexp_replace(F.lower("name"), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")
    steps = gazetteer.select(_pieces(key).alias("p"), "label").filter(F.size("p") > 0)
    made = F.aggregate("p", F.array(F.lit("")), lambda nodes, x: F.concat(nodes, F.array(F.md5(F.concat(F.element_at(nodes, -1), x)))))
    rows = steps.withColumn("n", made).select("label", F.size("p").alias("words"), F.posexplode(F.arrays_zip(F.slice("n", 1, F.size("p")).alias("node"), F.col("p").alias("piece"), F.slice("n", 2, F.size("p")).alias("child"))).alias("at", "e"))
    last = F.col("at") == F.col("words") - 1
    return rows.groupBy("e.node", "e.piece", "e.child").agg(F.min(F.when(last, F.col("label"))).alias("label"), F.max(~last).alias("more"), F.max("words").alias("words"))


def _pieces(text: Column) -> Column:
    """The first word of a text, and each other one with what stands before it."""
    return T.once(_matches(text, _TOKEN), lambda x: F.transform(F.zip_with(x["g"], x["m"], lambda g, m: F.struct(g.alias("g"), m.alias("m"))), lambda p, i: F.when(i == 0, p["m"]).otherwise(F.concat(p["g"], p["m"]))))


def _places(df: DataFrame, id_col: str, text_col: str, ahead: int) -> DataFrame:
    """(id, mark, pos, begin, pieces): each word of a text as a row, with the pieces of the `ahead` words from there on."""

    def words(x: Column) -> Column:
        pieces = F.zip_with(x["g"], x["m"], lambda g, m: F.concat(g, m))
        both = F.struct(_ends(x).alias("e"), pieces.alias("r"))
        return T.once(both, lambda b: F.transform(x["m"], lambda m, i: F.struct(i.alias("pos"), (F.get(b["e"], i) - F.length(m)).alias("begin"), F.concat(F.array(m), F.slice(b["r"], i + 2, ahead - 1)).alias("pieces"))))

    rows = df.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("mark"), F.explode(T.once(_matches(F.col(text_col), _TOKEN), words)).alias("t"))
    return rows.select("id", "mark", "t.*")


def _walk(places: DataFrame, trie: DataFrame, ahead: int) -> DataFrame:
    """(id, mark, pos, begin, found, before, node, words): the places at which a name begins, with the (text, label) of names
    that end within their pieces. Where a longer name goes on, node is where, before the text so far, words the longest's.

    Levels are joined one after another; a place that no name begins at is gone after the first.
    """
    none = F.array().cast("array<struct<text:string,label:string>>")
    rows = places.withColumns({"node": F.lit(""), "found": none})
    step = trie.select(*[F.col(c).alias(f"__{c}") for c in ("node", "piece", "child", "label", "more", "words")])
    for k in range(ahead):
        level = step.filter("__node = ''") if k == 0 else step.filter("__node != ''")
        met = rows.join(level, (F.col("node") == F.col("__node")) & (F.lower(F.get("pieces", F.lit(k))) == F.col("__piece")), "inner" if k == 0 else "left")
        ended = F.struct(F.array_join(F.slice("pieces", 1, k + 1), "").alias("text"), F.col("__label").alias("label"))
        found = F.when(F.col("__label").isNotNull(), F.concat("found", F.array(ended))).otherwise(F.col("found"))
        rows = met.select("id", "mark", "pos", "begin", "pieces", found.alias("found"), F.when(F.col("__more"), F.col("__child")).alias("node"), F.col("__words").alias("words"))
    return rows.select("id", "mark", "pos", "begin", "found", F.array_join("pieces", "").alias("before"), "node", "words")


def _longer(df: DataFrame, on: DataFrame, trie: DataFrame, id_col: str, text_col: str, ahead: int) -> DataFrame:
    """(id, begin, text, label) of names of more than `ahead` words; `on` has the places that are on the way to one.

    Only texts with such places are looked at again, and of these only as many words as the longest name that begins
    like that has. What the trie calls the nodes there follows from the words.
    """
    held = on.groupBy("id", "mark").agg(F.collect_set(F.struct("pos", "begin", "before", "node", "words")).alias("at")).withColumnsRenamed({"id": "__id", "mark": "__mark"})
    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(held, F.col("id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__mark")))

    def rest(x: Column) -> Column:
        pieces = F.zip_with(x["g"], x["m"], lambda g, m: F.concat(g, m))
        return T.once(pieces, lambda r: F.transform("at", lambda p: F.struct(p["begin"].alias("begin"), p["before"].alias("before"), p["node"].alias("node"), F.slice(r, p["pos"] + ahead + 1, p["words"] - ahead).alias("rest"))))

    rows = texts.select("id", F.explode(T.once(_matches(F.col("text"), _TOKEN), rest)).alias("p")).select("id", "p.*")
    made = F.aggregate("rest", F.array("node"), lambda nodes, x: F.concat(nodes, F.array(F.md5(F.concat(F.element_at(nodes, -1), F.lower(x))))))
    ways = rows.withColumn("n", made).select("id", "begin", "before", "rest", F.posexplode("n").alias("k", "child")).filter("k > 0")
    names = trie.filter("label is not null").select("child", "label")
    met = ways.join(names, "child")
    return met.select("id", "begin", F.concat("before", F.array_join(F.slice("rest", F.lit(1), F.col("k")), "")).alias("text"), "label")


def name_entities(df: DataFrame, gazetteer: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, label, start, end) of the gazetteer's names (name, label), in any case and of any number of
    words; a name inside a longer one is given too. Signs at the ends of a name don't count. Equal names have their least label.

    The names' trie is joined level by level, and a word's place moves on only while its prefix is a node. A place
    carries AHEAD words along; only texts with a place that is then still on the way to a longer name are looked at
    again, so names of hundreds of words cost no more than their own beginnings. Spark broadcasts the trie if its
    size allows and shuffles otherwise; texts aren't carried along. Repeated rows each have their names.
    """
    with scratch(df.sparkSession):
        trie = name_trie(gazetteer)
        longest = trie.agg(F.max("words")).first()[0] or 0
        trie = materialize(trie, "names") if longest > AHEAD else trie
        ahead = max(1, min(longest, AHEAD))
        walked = _walk(_places(df, id_col, text_col, ahead), trie, ahead)
        if longest > AHEAD:
            walked = materialize(walked, "places")
        found = walked.select("id", "begin", F.inline("found"))
        on = walked.filter("node is not null")
        if longest > AHEAD and not on.isEmpty():
            found = found.unionByName(_longer(df, on, trie, id_col, text_col, ahead))
        found = found.select(F.col("id").alias(id_col), "text", "label", F.col("begin").cast("long").alias("start"), (F.col("begin") + F.length("text")).cast("long").alias("end"))
        return materialize(found, "named", keep=True) if longest > AHEAD else found


def extract_entities(df: DataFrame, gazetteer: DataFrame, id_col: str = "doc_id", text_col: str = "text", offsets: bool = False) -> DataFrame:
    """(id, text, label[, start, end]) of patterns and names. Null and blank texts have none."""
    found = pattern_entities(df, id_col, text_col).union(name_entities(df, gazetteer, id_col, text_col))
    return found if offsets else found.select(id_col, "text", "label")


def entity_counts(entities: DataFrame) -> DataFrame:
    """(label, text, n) over a corpus, names in lower case; map-side sums."""
    return entities.groupBy("label", F.lower("text").alias("text")).agg(F.count(F.lit(1)).alias("n"))


def top_entities(entities: DataFrame, k: int) -> DataFrame:
    """The k most frequent entities of each label, ties by text; the group limit runs before the shuffle."""
    best = Window.partitionBy("label").orderBy(F.desc("n"), "text")
    return entity_counts(entities).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def affected_regions(entities: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, regions): distinct place names, sorted."""
    return entities.filter("label = 'GPE'").groupBy(id_col).agg(F.sort_array(F.collect_set("text")).alias("regions"))


def keyword_array(text: Column) -> Column:
    """Distinct lower-case words of letters that aren't stop words, sorted."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}+)"), F.lit(1))
    return F.array_sort(F.array_except(words, F.array(*map(F.lit, R.STOP_WORDS))))


def keywords(df: DataFrame, entities: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, keywords): keyword_array() and, if given, the lower-cased texts of ORG, GPE, DATE and MONEY entities."""
    plain = df.select(id_col, keyword_array(F.col(text_col)).alias("keywords"))
    if entities is None:
        return plain
    named = entities.filter(F.col("label").isin("ORG", "GPE", "DATE", "MONEY")).groupBy(id_col).agg(F.collect_set(F.lower("text")).alias("__n"))
    return plain.join(named, id_col, "left").select(id_col, F.array_sort(F.array_union("keywords", F.coalesce("__n", F.array().cast("array<string>")))).alias("keywords"))


def shared_keywords(sections: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, shared_keywords) of section1 and section2. Narrow."""
    return sections.select(id_col, F.array_sort(F.array_intersect(keyword_array(F.col("section1")), keyword_array(F.col("section2")))).alias("shared_keywords"))


def entity_overlap(pairs: DataFrame, entities: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id_a, id_b, overlap): distinct lower-cased entity texts on both sides, sorted. Entities are worked out once for both sides."""
    empty = F.array().cast("array<string>")
    with scratch(pairs.sparkSession):
        sets = materialize(entities.groupBy(id_col).agg(F.collect_set(F.lower("text")).alias("s")), "entity-sets")
        sides = pairs.select("id_a", "id_b").join(sets.toDF("id_a", "a"), "id_a", "left").join(sets.toDF("id_b", "b"), "id_b", "left")
        return materialize(sides.select("id_a", "id_b", F.array_sort(F.array_intersect(F.coalesce("a", empty), F.coalesce("b", empty))).alias("overlap")), "overlaps", keep=True)


def compare_entities(df: DataFrame, pairs: DataFrame, gazetteer: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_a, id_b, similarity, overlap, word_count_a, word_count_b) of pairs whose both texts aren't blank: TF-IDF
    cosine, common entities, and words that aren't punctuation."""
    from .compare import text_similarity
    from .stats import nonpunct_word_count

    with scratch(df.sparkSession):
        there = df.filter(T.non_empty(F.col(text_col))).select(id_col, F.col(text_col).alias("text"))
        counts = materialize(there.select(id_col, nonpunct_word_count(F.col("text")).alias("n")), "counts-of-words")
        asked = materialize(pairs.select("id_a", "id_b").join(counts.toDF("id_a", "word_count_a"), "id_a").join(counts.toDF("id_b", "word_count_b"), "id_b"), "asked-with-counts")
        keys = asked.select("id_a", "id_b")
        shared = entity_overlap(keys, extract_entities(there, gazetteer, id_col, "text"), id_col)
        found = asked.join(text_similarity(there, keys, id_col, "text"), ["id_a", "id_b"]).join(shared, ["id_a", "id_b"])
        return materialize(found.select("id_a", "id_b", "similarity", "overlap", "word_count_a", "word_count_b"), "compared-entities", keep=True)


def key_phrases(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, phrase, score, n): runs of words between stop words and punctuation. A phrase scores the sum of
    its words' mean phrase lengths in the document, divided by its own length's count of words."""
    stop = rf"(?i)(?<![\p{{L}}\p{{N}}])(?:{'|'.join(R.STOP_WORDS)})(?![\p{{L}}\p{{N}}])|[^\p{{L}}\p{{N}}\s'-]+"
    raw = F.filter(F.transform(F.split(F.lower(F.col(text_col)), stop), lambda p: T.strip(T.replace(p, r"\s+", " "))), lambda p: p.rlike(r"\p{L}"))
    phrases = df.select(id_col, F.explode(raw).alias("phrase")).groupBy(id_col, "phrase").agg(F.count(F.lit(1)).alias("n"))
    words = phrases.select(id_col, "phrase", "n", F.split("phrase", " ").alias("w")).select(id_col, "phrase", "n", F.size("w").alias("k"), F.explode("w").alias("word"))
    of = Window.partitionBy(id_col, "word")
    degree = words.withColumn("mean", F.sum(F.col("k") * F.col("n")).over(of) / F.sum("n").over(of))
    return degree.groupBy(id_col, "phrase").agg(F.round(F.avg("mean"), 6).alias("score"), F.max("n").alias("n"))


def summary_column(text: Column, max_input: int | None = 4000, max_words: int = 120, min_words: int = 0) -> Column:
    """Extractive summary of one text: the sentences with the highest mean word frequency, best first as
    long as they sum to max_words at most (the first always, and any while there are fewer than min_words),
    in the order of the text. Only the first max_input characters are read; None: all. Words meet by
    sorting, so time is that of a sort."""

    def of(parts: Column) -> Column:
        words = F.flatten(F.transform(parts, lambda s, i: F.transform(T.tokenize_words(s), lambda w: F.struct(w.alias("w"), i.alias("i")))))
        return T.once(F.sort_array(words), lambda w: T.once(F.sort_array(counted(w)), lambda c: T.once(ranked(c), lambda r: shown(parts, r))))

    def counted(w: Column) -> Column:
        """(i, c) for each word: its sentence and its count in the text."""
        return F.flatten(F.transform(T.runs(w, lambda x: x["w"]), lambda r: F.transform(F.slice(w, r["at"] + 1, r["n"]), lambda x: F.struct(x["i"].alias("i"), r["n"].alias("c")))))

    def ranked(c: Column) -> Column:
        """(score, -i, words) of the sentences that have words, best first."""
        mean = F.transform(T.runs(c, lambda x: x["i"]), lambda r: F.struct(F.round(F.aggregate(F.slice(c, r["at"] + 1, r["n"]), F.lit(0).cast("long"), lambda s, x: s + x["c"]) / r["n"], 6).alias("score"), (-F.get(c, r["at"])["i"]).alias("back"), r["n"].alias("n")))
        return F.sort_array(mean, asc=False)

    def shown(parts: Column, r: Column) -> Column:
        used = T.running_sums(F.transform(r, lambda x: x["n"]))
        fine = T.once(used, lambda u: F.filter(F.transform(r, lambda x, k: F.when((k == 0) | (F.get(u, k) <= max_words) | (F.get(u, k) - x["n"] < min_words), -x["back"])), lambda i: i.isNotNull()))
        return F.array_join(F.transform(F.sort_array(fine), lambda i: F.get(parts, i)), " ")

    return T.once(T.sentences(text if max_input is None else T.truncate_text(text, max_input)), of)


def summarize(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_input: int | None = 4000, max_words: int = 120, min_words: int = 0) -> DataFrame:
    """(id, summary) by summary_column(). Narrow."""
    return df.select(id_col, summary_column(F.col(text_col), max_input, max_words, min_words).alias("summary"))
