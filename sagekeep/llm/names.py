"""Linking the spellings of people and organisations (problem 2).

A name is cut to words without case, accents, titles and legal forms. All words
are joined with each other by sharded tries (see ``tries``). Words are told apart
by their company, what else stands in the names that they stand in: a word is a
slip of a near one that has several times its company, or shares a good part of
it, or is listed. In each name the word of least company is its core (the family
name, the organisation's own word), whatever the order of the words, unless a
comma says which it is; every other word of nearly as little company is tried as
the core too. All the rest of the name, in any order, is its label (the given
names, the line of business). Short forms of labels come from the list of
aliases, and from the data: a label that mostly stands beside a longer one under
the same cores, or in an entity's recorded key, is a short form of it.

Two names are linked if their labels mean the same and their cores are equal or
within few edits: one, or two where both cores have eight letters or more. An
initial, a short form of several names, and a name that leaves out some of
another's given names are linked only where just one person or organisation
fits. Recorded merges and keys are links too. Groups are the connected components
of all links. Neither a core alone nor a label alone links.

All rules compare shares, so that they say the same of a table and of a hundred
times as much.

Defined results: rows of other types take no part (types are compared without
case and blanks); rows that repeat an id are one, with the smallest of each
value; null and blank names, and names without a word of two letters, are linked
only by recorded merges and keys; merges into ids that aren't there, or of
another type, are left out; an empty alias table is no error; very long names
are read whole, and labels of more than ``SPELT_WORDS`` words are compared by a
hash; equal names are one spelling, however many rows have it, and their rows
come out as pairs; further columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sagekeep.llm.components import components
from sagekeep.llm.tries import distance, near_words
from sagekeep.runtime import hot_values, materialise, strip

#: Names that an alias list may have; a longer one is refused.
MOST_ALIASES = 100_000
#: Times the company of a word that another must have to outweigh it, and that a near word must have for the word to
#: be a slip of it; a listed one need only outweigh it.
SEVERAL, MANY = 4, 10
#: Part of a word's company that a near word must share, and part of a label's cores that a longer one must share,
#: for the two to be one. A single meeting under a core is no evidence for labels, whatever its part.
SHARED_PART, LEAST_MEETINGS = 0.4, 2
#: Times the part of all cores under which the longer label stands, that the part of the shorter one's cores must be.
BEYOND_CHANCE = 1.5
#: Words of a label that are kept as text; longer ones are kept as a hash. Parts that a hot group of rows is spread to.
SPELT_WORDS, SALTS = 12, 32
#: Words around personal names, and words without meaning in those of organisations.
TITLES = {"dr", "prof", "mr", "mrs", "ms", "miss", "sir", "dame", "jr", "sr", "phd", "md"}
FILLERS = {"the", "and", "of"}
#: Digits that stand for letters.
DIGITS = str.maketrans("0134578", "oieastb")


def fold(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", text.casefold()) if not unicodedata.combining(c))


class NameParser:
    """Words, initials and the part before a comma of names; holds the alias list."""

    def __init__(self, aliases: list[tuple[str, str, str]]) -> None:
        self.suffixes: set[str] = set()
        self.phrases: dict[tuple[str, ...], tuple[str, ...]] = {}
        self.fulls: dict[str, set[str]] = {}
        self.listed: dict[str, set[str]] = {"PERSON": set(), "ORG": set()}
        for alias, full, kind in aliases:
            short, long = self.words("ORG", alias), self.words("ORG", full)
            if kind == "org_suffix":
                self.suffixes |= {"".join(short), "".join(long)}
            elif kind == "org_word":
                self.phrases[tuple(short)] = tuple(long)
                self.listed["ORG"] |= set(long)
            elif kind == "given" and short and long:
                self.fulls.setdefault(short[0], set()).add(long[0])
                self.listed["PERSON"] |= {short[0], long[0]}

    @staticmethod
    def words(kind: str, text: str) -> list[str]:
        if kind == "ORG":
            text = re.sub(r"(?<=[a-z])(?=[A-Z][a-z])", " ", text).replace(".", "")
        found = re.findall(r"[^\W_]+", fold(text))
        return [w.translate(DIGITS) if not w.isdigit() and not w.isalpha() else w for w in found]

    def parse(self, kind: str, text: str) -> tuple[list[str], str, list[str]]:
        """Words of two letters and more, the first initial, and the words before a comma."""
        if kind == "PERSON":
            words = [w for w in self.words(kind, text) if w not in TITLES]
            before = self.words(kind, text.partition(",")[0]) if "," in text else []
            return [w for w in words if len(w) > 1], next((w for w in words if len(w) == 1), ""), before
        words = [w for w in self.words(kind, text) if w not in FILLERS]
        while len(words) > 1 and self.is_suffix(words[-1]):
            words.pop()
        for size in (3, 2, 1):
            for at in range(len(words) - size, -1, -1):
                if size < len(words) and tuple(words[at : at + size]) in self.phrases:
                    words[at : at + size] = self.phrases[tuple(words[at : at + size])]
        return [w for w in words if len(w) > 1], "", []

    def is_suffix(self, word: str) -> bool:
        return word in self.suffixes or (
            len(word) >= 5 and any(len(s) >= 5 and abs(len(s) - len(word)) < 2 and distance(word, s) < 2 for s in self.suffixes)
        )


def _spellings(entities: DataFrame, parser: NameParser) -> DataFrame:
    """id, part (0 the name, 1 the recorded key), name, kind, words, initial, before for each row's spellings.

    ``name`` is the same for all spellings of the same kind, words, initial and words before a comma.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, texts = batch.column(1).to_pylist(), batch.column(3).to_pylist()
            parsed = [parser.parse(k, t) for k, t in zip(kinds, texts, strict=True)]
            words, initials, before = zip(*parsed, strict=True) if parsed else ((), (), ())
            lists = pa.list_(pa.string())
            columns = [*batch.columns[:3], pa.array(words, lists), pa.array(initials, pa.string()), pa.array(before, lists)]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "kind", "part", "words", "initial", "before"])

    key = F.regexp_replace("norm_key", r"^\s*\w+\s*:", "")
    texts = F.array(
        F.struct(F.lit(0).alias("part"), F.col("canonical_name").alias("text")), F.struct(F.lit(1).alias("part"), key.alias("text"))
    )
    told = F.concat_ws("|", "kind", F.array_join("words", " "), "initial", F.array_join("before", " "))
    return (
        entities.select("id", "kind", F.explode(texts).alias("t"))
        .select("id", "kind", "t.part", "t.text")
        .filter("text IS NOT NULL")
        .mapInArrow(run, "id string, kind string, part int, words array<string>, initial string, before array<string>")
        .filter(F.size("words") > 0)
        .withColumn("name", F.md5(told))
    )


#: Hashes of words are added modulo this, so that a sum doesn't depend on their order and can't overflow.
_MODULUS = 2**62


def _word_hash(word: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(word), 2)


def _sum_of_hashes(words: Column) -> Column:
    return F.aggregate(words, F.lit(0).cast("long"), lambda total, w: F.pmod(total + _word_hash(w), F.lit(_MODULUS)))


def _without(total: Column, word: Column) -> Column:
    """The sum of hashes of all words but one."""
    return F.pmod(total - _word_hash(word), F.lit(_MODULUS))


def _word_table(names: DataFrame, listed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """kind, word, fixed, listed, partners of each word, and the near pairs of words, both ways.

    A word's company is the set of what is left of its names without it; its
    partners are their number. ``fixed`` is what a slip stands for, else the word.
    """
    distinct = names.select("kind", F.array_distinct("words").alias("words")).withColumn("total", _sum_of_hashes(F.col("words")))
    beside = F.when(F.size("words") > 1, _without(F.col("total"), F.col("word")))
    company = distinct.withColumn("word", F.explode("words")).select("kind", "word", beside.alias("beside")).distinct()
    company = materialise(company, "company")
    words = company.groupBy("kind", "word").agg(F.count("beside").alias("partners"))
    words = words.join(listed, ["kind", "word"], "left").withColumn("listed", F.coalesce("listed", F.lit(False)))
    words = materialise(words, "words")
    found = materialise(near_words(words), "near-words")
    near = found.unionByName(found.select("kind", F.col("other").alias("word"), F.col("word").alias("other"), "distance"))
    targets = words.select("kind", F.col("word").alias("other"), F.col("partners").alias("p"), F.col("listed").alias("l"))
    rank = F.struct(F.col("l"), F.col("p"), F.col("other")) > F.struct(F.col("listed"), F.col("partners"), F.col("word"))
    upward = near.join(words.filter("NOT listed"), ["kind", "word"]).join(targets, ["kind", "other"]).filter(rank)
    times = F.when(F.col("l"), SEVERAL).otherwise(MANY)
    outweighed = F.col("p") >= times * F.greatest("partners", F.lit(1))
    upward = materialise(upward.withColumn("outweighed", outweighed), "upward")
    doubted = upward.filter("NOT outweighed AND partners > 0").select("kind", "word", "other")
    shared = (
        doubted.join(company, ["kind", "word"])
        .join(company.withColumnRenamed("word", "other"), ["kind", "other", "beside"])
        .groupBy("kind", "word", "other")
        .agg(F.count(F.lit(1)).alias("shared"))
    )
    told = upward.join(shared, ["kind", "word", "other"], "left").filter(
        F.col("outweighed") | (F.col("shared") >= SHARED_PART * F.col("partners"))
    )
    order = F.struct("distance", ~F.col("l"), -F.col("p"), "other")
    slips = told.groupBy("kind", "word").agg(F.min_by("other", order).alias("fixed"))
    # What a slip was taken for may be a slip itself.
    onward = slips.select("kind", F.col("word").alias("fixed"), F.col("fixed").alias("further"))
    slips = slips.join(onward, ["kind", "fixed"], "left").select("kind", "word", F.coalesce("further", "fixed").alias("fixed"))
    table = words.join(slips, ["kind", "word"], "left").withColumn("fixed", F.coalesce("fixed", "word"))
    weights = targets.select("kind", F.col("other").alias("fixed"), "p", "l")
    table = table.join(weights, ["kind", "fixed"]).select("kind", "word", "fixed", F.col("l").alias("listed"), F.col("p").alias("partners"))
    return materialise(table, "word-table"), near


def _forms(names: DataFrame, words: DataFrame) -> DataFrame:
    """name, kind, core, label, initial, first: the cores of each name, and all that stands beside them.

    The word of least company is the first core; every word that it doesn't outweigh is tried as one too.
    """
    placed = names.select("name", "kind", "initial", "before", F.posexplode("words").alias("at", "word"))
    weighed = placed.join(words, ["kind", "word"]).withColumn("other", F.size("before") > 0)
    weighed = weighed.withColumn("other", F.col("other") & ~F.array_contains("before", F.col("word")))
    items = F.sort_array(F.collect_list(F.struct("other", "listed", "partners", "at", "word", "fixed"))).alias("items")
    head = F.col("items")[0]
    fits = lambda w: (w["listed"] == head["listed"]) & ~w["other"] & (w["partners"] < SEVERAL * F.greatest(head["partners"], F.lit(1)))
    cores = F.filter("items", lambda w, i: (i == 0) | fits(w))
    rest = F.transform(F.filter("items", lambda w: w["at"] != F.col("c.at")), lambda w: w["fixed"])
    spelt = F.array_join(F.array_sort(rest), " ")
    hashed = F.concat(F.lit("#"), F.hex(_without(F.col("total"), F.col("c.fixed"))))
    return (
        weighed.groupBy("name", "kind", "initial")
        .agg(items)
        .withColumn("total", F.when(F.size("items") > SPELT_WORDS, _sum_of_hashes(F.transform("items", lambda w: w["fixed"]))))
        .select("*", F.posexplode(cores).alias("turn", "c"))
        .withColumn("label", F.when(F.col("total").isNull(), spelt).otherwise(hashed))
        .select("name", "kind", "initial", F.col("c.word").alias("core"), "label", (F.col("turn") == 0).alias("first"))
        .distinct()
    )


def _label_table(forms: DataFrame, parser: NameParser) -> DataFrame:
    """kind, label, n, first_n, fulls, full, unexplained of the labels that stand beside cores, and of listed full names.

    ``n`` counts the cores, ``first_n`` those that are the first of their names.
    ``fulls`` are the listed meanings of a short form; ``full`` marks a listed
    full name. Labels that are neither are unexplained.
    """
    spark = forms.sparkSession
    rows = {("PERSON", short): (sorted(full), False) for short, full in parser.fulls.items()}
    whole = {("PERSON", f) for f in set().union(*parser.fulls.values())} | {("ORG", " ".join(sorted(p))) for p in set(parser.phrases.values())}
    rows |= {key: (rows.get(key, (None,))[0], True) for key in whole}
    listed = spark.createDataFrame([(*key, *value) for key, value in sorted(rows.items())], "kind string, label string, fulls array<string>, full boolean")
    first = F.count_distinct(F.when(F.col("first"), F.col("core"))).alias("first_n")
    met = forms.groupBy("kind", "label").agg(F.count_distinct("core").alias("n"), first)
    table = met.join(listed, ["kind", "label"], "full").fillna(0, ["n", "first_n"]).fillna(False, ["full"])
    return materialise(table.withColumn("unexplained", F.col("fulls").isNull() & ~F.col("full") & (F.col("label") != "")), "labels")


def _learned(forms: DataFrame, told_by: DataFrame, merged: DataFrame, labels: DataFrame) -> DataFrame:
    """kind, label, longer: short forms that the data show, for labels that the alias list doesn't explain."""
    first = forms.filter("first AND label <> ''")
    under = first.select("kind", "core", "label").distinct().join(labels.select("kind", "label", "unexplained", "full", "first_n"), ["kind", "label"])
    under = materialise(under, "labels-of-cores")
    longer = under.select("kind", "core", F.col("label").alias("longer"), "full", F.col("first_n").alias("frequent"))
    met = under.filter("unexplained").select("kind", "core", "label").join(longer, ["kind", "core"]).filter("label <> longer")
    cores = met.groupBy("kind", "label").agg(F.count_distinct("core").alias("cores"))
    both = met.groupBy("kind", "label", "longer").agg(F.count(F.lit(1)).alias("shared"))
    # What recorded keys and merges say: the label of a row beside that of its key, or of the row it was merged into.
    names = materialise(told_by.join(first.select("name", "kind", "label"), "name").select("id", "kind", "part", "label"), "told-labels")
    own = names.filter("part = 0").select("id", "kind", "label")
    of_root = merged.join(own.withColumnRenamed("id", "root"), "root").select("id", "kind", F.col("label").alias("longer"))
    beside = names.filter("part = 1").select("id", "kind", F.col("label").alias("longer")).unionByName(of_root)
    told = own.join(beside, ["id", "kind"]).filter("label <> longer").groupBy("kind", "label", "longer").agg(F.count(F.lit(1)).alias("told"))
    everywhere = under.groupBy("kind").agg(F.count_distinct("core").alias("everywhere"))
    usual = (
        (F.col("shared") >= LEAST_MEETINGS)
        & (F.col("shared") >= SHARED_PART * F.col("cores"))
        & (F.col("shared") / F.col("cores") >= BEYOND_CHANCE * F.col("frequent") / F.col("everywhere"))
    )
    score = F.struct(F.coalesce("told", F.lit(0)) * 2 + F.coalesce("shared", F.lit(0)), F.col("longer"))
    of_longer = labels.select("kind", F.col("label").alias("longer"), "full", F.col("first_n").alias("frequent"))
    return (
        both.join(told, ["kind", "label", "longer"], "full")
        .join(labels.filter("unexplained").select("kind", "label"), ["kind", "label"], "left_semi")
        .join(cores, ["kind", "label"], "left")
        .join(of_longer, ["kind", "longer"], "left")
        .join(everywhere, "kind", "left")
        .filter(usual | (F.col("told") >= 1) & (F.col("frequent") >= LEAST_MEETINGS))
        .filter(F.col("full") | (F.length("longer") > F.length("label")))
        .groupBy("kind", "label")
        .agg(F.max_by("longer", score).alias("longer"))
    )


def _shortened(labels: DataFrame) -> DataFrame:
    """kind, label, longer: labels that shorten just one listed label, or one met at least as often, word for word.

    A person's short name starts the long one; an organisation's word may leave out letters anywhere.
    """
    known = labels.filter("label <> '' AND NOT startswith(label, '#')")
    short = known.filter("unexplained AND length(label) >= 3").select("kind", "label", "n")
    long = known.select("kind", F.col("label").alias("longer"), F.col("n").alias("often"), "full")
    starts = F.transform(F.sequence(F.lit(3), F.length("longer") - 1), lambda n: F.substring("longer", F.lit(1), n))
    by_start = long.filter("kind = 'PERSON' AND length(longer) > 3 AND NOT contains(longer, ' ')").withColumn("label", F.explode(starts))
    people = short.join(by_start, ["kind", "label"])
    initials = lambda c: F.array_join(F.transform(F.split(c, " "), lambda w: F.substring(w, 1, 1)), "")
    gaps = F.concat(F.lit("^"), F.regexp_replace("label", r"([^ ])", "$1[^ ]*"), F.lit("$"))
    business = short.filter("kind = 'ORG'").withColumn("starts", initials(F.col("label"))).withColumn("pattern", gaps)
    business = business.join(long.withColumn("starts", initials(F.col("longer"))), ["kind", "starts"])
    business = business.filter("label <> longer AND length(longer) > length(label) AND longer RLIKE pattern")
    columns = ["kind", "label", "longer", "n", "often", "full"]
    fits = people.select(columns).unionByName(business.select(columns)).filter("full OR often >= n")
    return fits.groupBy("kind", "label").agg(F.min("longer").alias("longer"), F.count(F.lit(1)).alias("k")).filter("k = 1").drop("k")


def _meanings(forms: DataFrame, told_by: DataFrame, merged: DataFrame, parser: NameParser) -> DataFrame:
    """kind, label, meaning, options: what each label stands for, or the several names that it may stand for."""
    labels = _label_table(forms, parser)
    learned = _learned(forms, told_by, merged, labels).withColumnRenamed("longer", "l1")
    shortened = _shortened(labels).withColumnRenamed("longer", "l2")
    own = labels.join(learned, ["kind", "label"], "left").join(shortened, ["kind", "label"], "left")
    own = materialise(own.select("kind", "label", "n", "fulls", F.coalesce("l1", "l2").alias("step")), "label-steps")
    # A learned longer form may itself be a listed short form, or be explained by a further one.
    onward = own.select("kind", F.col("label").alias("step"), F.col("step").alias("further"), F.col("fulls").alias("of_step"))
    table = own.join(onward, ["kind", "step"], "left")
    fulls = F.coalesce("fulls", "of_step")
    several = F.size(fulls) > 1
    single = table.select(
        "kind",
        "label",
        "n",
        F.when(several, None).otherwise(F.coalesce(fulls[0], "further", "step", "label")).alias("meaning"),
        F.when(several, fulls).alias("options"),
    )
    single = materialise(single, "label-meanings")
    # Of several given names each is explained by itself, where it has one meaning.
    parts = single.filter("kind = 'PERSON' AND contains(label, ' ')").select("kind", "label", F.explode(F.split("label", " ")).alias("part"))
    known = single.select("kind", F.col("label").alias("part"), F.col("meaning").alias("of_part"))
    whole = F.array_join(F.array_sort(F.collect_list(F.coalesce("of_part", "part"))), " ")
    several_names = parts.join(known, ["kind", "part"], "left").groupBy("kind", "label").agg(whole.alias("whole"))
    return single.filter("n > 0").join(several_names, ["kind", "label"], "left").select(
        "kind", "label", F.coalesce("whole", "meaning").alias("meaning"), F.when(F.col("whole").isNull(), F.col("options")).alias("options")
    )


def _node(*parts: Column | str) -> Column:
    return F.concat_ws("|", *parts)


def link_names(entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """id, entity for each person and organisation: rows with the same entity are one.

    ``entities`` has id, entity_type, canonical_name, norm_key and merged_into;
    ``aliases`` has alias, full_form and kind, at most ``MOST_ALIASES`` rows.
    """
    rows = aliases.filter("alias IS NOT NULL AND full_form IS NOT NULL").select("alias", "full_form", "kind").distinct()
    rows = [tuple(r) for r in rows.limit(MOST_ALIASES + 1).collect()]
    if len(rows) > MOST_ALIASES:
        raise ValueError(f"more than {MOST_ALIASES} aliases")
    parser = NameParser(sorted(rows))
    spark = entities.sparkSession
    kind = F.upper(strip("entity_type"))
    known = (
        entities.filter(F.col("id").isNotNull() & kind.isin("PERSON", "ORG"))
        .groupBy(F.col("id").cast("string").alias("id"))
        .agg(
            F.min(kind).alias("kind"),
            F.min("canonical_name").alias("canonical_name"),
            F.min("norm_key").alias("norm_key"),
            F.min(strip("merged_into")).alias("merged_into"),
        )
    )
    known = materialise(known, "named")
    merged = known.filter("merged_into IS NOT NULL").select("id", F.col("merged_into").alias("root"), "kind")
    merged = merged.join(known.select(F.col("id").alias("root"), "kind"), ["root", "kind"]).select("id", "root")
    spellings = materialise(_spellings(known, parser), "spellings")
    told_by = spellings.select("id", "part", "name")
    names = materialise(spellings.select("name", "kind", "words", "initial", "before").dropDuplicates(["name"]), "distinct-names")
    listed = [(k, w) for k, words in parser.listed.items() for w in sorted(words)]
    listed = spark.createDataFrame(listed, "kind string, word string").withColumn("listed", F.lit(True))
    words, near = _word_table(names, listed)
    forms = materialise(_forms(names, words), "forms")
    meant = materialise(forms.join(_meanings(forms, told_by, merged, parser), ["kind", "label"]), "meant")
    sure = meant.filter("label <> '' AND meaning IS NOT NULL").withColumn("node", _node("kind", "core", "meaning"))
    sure = materialise(sure.select("name", "kind", "core", "meaning", "node"), "sure")
    nodes = sure.select("kind", "core", "meaning", "node").distinct()
    cores = near.select("kind", F.col("word").alias("core"), F.col("other").alias("near_core"), "distance")
    by_core = (
        nodes.join(cores.filter("core < near_core"), ["kind", "core"])
        .select("kind", F.col("near_core").alias("core"), "meaning", F.col("node").alias("a"))
        .join(nodes.withColumnRenamed("node", "b"), ["kind", "core", "meaning"])
        .select("a", "b")
    )
    # Rows with one spelling are one vertex: the least node of it; those without a sure spelling are vertices of their own.
    heads = materialise(sure.groupBy("name").agg(F.min("node").alias("head"), F.max("node").alias("last")), "name-heads")
    by_name = sure.join(heads.filter("head <> last").drop("last"), "name").filter("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b"))
    of_row = told_by.join(heads, "name").groupBy("id").agg(F.min("head").alias("vertex"), F.max("head").alias("last"))
    of_row = materialise(of_row, "row-vertices")
    by_row = of_row.filter("vertex <> last").select(F.col("vertex").alias("a"), F.col("last").alias("b"))
    vertex = F.coalesce("vertex", _node(F.lit("id"), F.col("id")))
    ends = known.join(of_row, "id", "left").select("id", vertex.alias("vertex"))
    by_merge = merged.join(ends.withColumnRenamed("vertex", "a"), "id").join(ends.select(F.col("id").alias("root"), F.col("vertex").alias("b")), "root")
    links = by_core.unionByName(by_name).unionByName(by_row).unionByName(by_merge.select("a", "b")).filter("a <> b").distinct()
    found = components(links)
    linked = ends.join(found.withColumnRenamed("node", "vertex"), "vertex", "left")
    of_row = linked.select("id", F.coalesce("component", F.when(~F.startswith("vertex", F.lit("id|")), F.col("vertex"))).alias("component"))
    of_row = materialise(of_row.filter("component IS NOT NULL"), "row-groups")
    groups = nodes.join(found, "node", "left").select("kind", "core", "meaning", F.coalesce("component", "node").alias("component"))
    groups = materialise(groups, "core-groups")
    unsure = _unsure(meant, told_by, sure, groups)
    # They go to the only group that fits, among the nearest cores.
    own = unsure.select("open", "kind", "core", "how", "asked", F.lit(0).alias("distance"))
    others = unsure.join(cores.filter("distance = 1"), ["kind", "core"]).select(
        "open", "kind", F.col("near_core").alias("core"), "how", "asked", "distance"
    )
    initial = F.struct(F.lit("initial").alias("how"), F.substring("meaning", 1, 1).alias("asked"))
    whole = F.struct(F.lit("whole").alias("how"), F.col("meaning").alias("asked"))
    each = F.transform(
        F.when(F.contains("meaning", F.lit(" ")), F.split("meaning", " ")).otherwise(F.array().cast("array<string>")),
        lambda w: F.struct(F.lit("part").alias("how"), w.alias("asked")),
    )
    offered = groups.withColumn("o", F.explode(F.array_distinct(F.concat(F.array(initial, whole), each))))
    offered = offered.select("kind", "core", "o.how", "o.asked", "component").distinct()
    fits = own.unionByName(others).distinct().join(offered, ["kind", "core", "how", "asked"])
    at_distance = fits.groupBy("open", "distance").agg(F.min("component").alias("least"), F.max("component").alias("most"))
    chosen = at_distance.groupBy("open").agg(F.min_by(F.struct("least", "most"), "distance").alias("c"))
    chosen = chosen.filter("c.least = c.most").select("open", F.col("c.least").alias("component"))
    alone = fits.select("open").distinct()
    placed = (
        told_by.join(unsure.select("name", "open").distinct(), "name")
        .join(chosen, "open", "left")
        .join(alone.withColumn("met", F.lit(True)), "open", "left")
        # Names that nothing fits are one group; names that several groups fit stay single.
        .select("id", F.when(F.col("component").isNotNull(), F.col("component")).when(F.col("met").isNull(), F.col("open")).alias("fit"))
        .groupBy("id")
        .agg(F.min("fit").alias("fit"))
    )
    placed = materialise(placed.filter("fit IS NOT NULL"), "placed")
    # A row that a recorded merge, or a further spelling, ties to a group takes the group with it.
    ties = of_row.select("id", F.col("component").alias("a")).join(placed, "id").select("a", F.col("fit").alias("b"))
    joined = components(ties.filter("a <> b").distinct())
    return (
        known.select("id")
        .join(of_row, "id", "left")
        .join(placed, "id", "left")
        .select("id", F.coalesce("component", "fit", _node(F.lit("id"), F.col("id"))).alias("node"))
        .join(joined, "node", "left")
        .select("id", F.coalesce("component", "node").alias("entity"))
    )


def _unsure(meant: DataFrame, told_by: DataFrame, sure: DataFrame, groups: DataFrame) -> DataFrame:
    """name, open, kind, core, how, asked: names that say too little, and what a group that they may belong to must offer.

    Initials ask for a label that starts so, short forms of several names for one of these, and single given names
    for a label of several in which they stand. Rows with a further spelling that says enough aren't asked for.
    """
    settled = told_by.join(sure.select("name").distinct(), "name").select("id").distinct()
    waiting = told_by.join(settled, "id", "left_anti").select("name").distinct()
    vague = meant.filter("kind = 'PERSON' AND (options IS NOT NULL OR (label = '' AND initial <> ''))").join(waiting, "name", "left_semi")
    asked = F.when(F.col("options").isNotNull(), F.col("options")).otherwise(F.array("initial"))
    open_node = _node(F.lit("open"), "kind", "core", F.coalesce(F.array_join("options", " "), "initial"))
    vague = vague.select(
        "name", open_node.alias("open"), "kind", "core", F.when(F.col("options").isNull(), "initial").otherwise("whole").alias("how"),
        F.explode(asked).alias("asked"),
    )
    fewer = sure.filter("kind = 'PERSON' AND NOT contains(meaning, ' ') AND NOT startswith(meaning, '#')")
    several = groups.filter("kind = 'PERSON' AND contains(meaning, ' ')").select("core").distinct()
    fewer = fewer.join(several, "core", "left_semi")
    group = groups.select("kind", "core", "meaning", F.col("component").alias("open"))
    fewer = fewer.join(group, ["kind", "core", "meaning"]).select("name", "open", "kind", "core", F.lit("part").alias("how"), F.col("meaning").alias("asked"))
    return materialise(vague.unionByName(fewer), "unsure")


def linked_pairs(groups: DataFrame) -> DataFrame:
    """All pairs of ids of one entity: id_a < id_b; an entity that may have a great part of the rows is dealt to many tasks."""
    groups = materialise(groups.select("id", "entity"), "entities-of-rows")
    hot = hot_values(groups.select("entity"), "entity")
    is_hot = F.col("entity").isin(hot) if hot else F.lit(False)
    part = F.when(is_hot, F.pmod(F.xxhash64("id"), F.lit(SALTS))).otherwise(F.lit(0)).cast("int")
    parts = F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    left = groups.select("entity", F.col("id").alias("id_a"), part.alias("part"))
    right = groups.select("entity", F.col("id").alias("id_b"), F.explode(parts).alias("part"))
    return left.join(right, ["entity", "part"]).filter("id_a < id_b").select("id_a", "id_b")
