"""Secret scanning with a random forest that removes false positives, in DataFrame functions only."""
from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseweave.llm.common import cut

RUN = r"[A-Za-z0-9+/_\-]"
KEY_NAMES = "token|secret|passw|pwd|api_?-?key|apikey|auth|bearer|credential|private|access_?key"
KEY_WORD = rf"(?i)({KEY_NAMES})"
#: A key word's name with its assignment; words stand one blank apart.
ASSIGNED = rf"(?i:{KEY_NAMES})[\w\-]{{0,32}}[\"'`]? ?[=:]{{1,2}}>? ?[\"'`]?"
#: Runs of 16 or more key characters, and shorter ones right behind an assigned key word.
LONG = rf"{RUN}{{16}}"
CANDIDATE = rf"(?<!{RUN})(?:{RUN}{{16,}}|(?={RUN}{{1,15}}(?!{RUN}))(?<={ASSIGNED}){RUN}{{1,15}})={{0,2}}"
HASH_NAME = r"(?i)\b(commit|sha-?[0-9]*|md5|checksum|digest|revision|uuid|guid|etag|integrity)\b"
BLANKS = " \t\n\r\x0b\x0c"
EXAMPLE_PATH = r"(?i)(test|example|sample|mock|fixture|doc)"
FEATURES = ("length digits uppers hex only_digits variety letter_digit vowel_consonant case_changes coverage quoted "
            "key_before assign_before word_before word_after example_path path_bucket").split()


def candidates(docs: DataFrame, path: str = "source") -> DataFrame:
    """(doc_id, start, candidate, before2, before, after, left, quote, path) of every candidate in the whole texts.

    A candidate is a run of 16 or more key characters, or a shorter one right behind an assigned key word. start is its
    character offset; before2, before and after are the neighbouring words ('' at a text's ends); left is what stands
    in front of it in its own word, from the last of , ; & { } or the candidate before on, that candidate included.
    Only texts that hold a candidate are cut into words. A null or empty text has none. Rows that repeat a doc_id give
    their candidates each; a candidate that stands twice in one word is two, each with its own offset.
    """
    where = F.col(path).cast("string") if path in docs.columns else F.lit(None).cast("string")
    named = F.col("text").rlike(rf"(?i)({KEY_NAMES})[\w\-]{{0,32}}[\"'`]?\s*+[=:]")
    rows = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(where, F.lit("")).alias("path"))
            .withColumn("named", named).where(F.col("named") | F.col("text").rlike(LONG))
            .select("doc_id", "path", "named", F.regexp_extract_all("text", F.lit(r"\s*[^\s]+"), F.lit(0)).alias("words")))

    def bare(i: Column) -> Column:
        return F.coalesce(F.btrim(F.get("words", i), F.lit(BLANKS)), F.lit(""))

    def front(i: Column) -> Column:
        return F.concat(bare(i - 2), F.lit(" "), bare(i - 1), F.lit(" "))

    at = F.filter(F.transform("words", lambda w, i: F.struct(i.alias("i"), w.alias("w"))), lambda x: x["w"].rlike(LONG) | (
        F.col("named") & F.concat(front(x["i"]), bare(x["i"])).rlike(ASSIGNED)))
    i = F.col("at.i")
    lead = F.aggregate(F.slice("words", F.lit(1), i), F.lit(0), lambda n, w: n + F.char_length(w))
    pad = F.char_length("at.w") - F.char_length(bare(i))
    near = rows.select("doc_id", "path", "words", F.explode(at).alias("at")).select(
        "doc_id", "path", (lead + pad).alias("lead"), bare(i - 2).alias("before2"), bare(i - 1).alias("before"),
        bare(i + 1).alias("after"), F.char_length(front(i)).alias("skip"),
        F.split(F.regexp_replace(F.concat(front(i), bare(i)), CANDIDATE, "\n$0\n"), "\n").alias("parts"))
    # no word holds a line end, so candidates are the odd parts and what is between them the even ones
    placed = F.transform("parts", lambda p, k: F.struct(
        k.alias("k"), F.aggregate(F.slice("parts", F.lit(1), F.when(k % 2 == 1, k).otherwise(0)), F.lit(0),
                                  lambda n, q: n + F.char_length(q)).alias("at")))
    found = near.withColumn("hit", F.explode(F.filter(placed, lambda x: (x["k"] % 2 == 1) & (x["at"] >= F.col("skip")))))
    k, inside = F.col("hit.k"), F.col("hit.at") - F.col("skip")
    own = F.right(F.concat(F.coalesce(F.get("parts", k - 2), F.lit("")), F.get("parts", k - 1)), inside)
    return found.withColumn("own", own).select(
        "doc_id", (F.col("lead") + inside).cast("long").alias("start"), F.get("parts", k).alias("candidate"), "before2", "before",
        "after", F.regexp_extract("own", r"(?<![^,;&{}])[^,;&{}]*+$", 0).alias("left"),
        F.col("own").rlike("[\"'`=]$").alias("quote"), "path")


def dictionary(docs: DataFrame, least: int = 3) -> DataFrame:
    """(word, n): the runs of three or more letters that occur at least `least` times in the corpus, lower-cased.

    Every text is counted; the counts are combined map-side.
    """
    words = docs.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{3,}"), F.lit(0))).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def features(found: DataFrame, words: DataFrame) -> DataFrame:
    """found with the feature columns: length, character classes and transitions, share of letters in dictionary
    words, neighbouring words and path. All are numbers, never null."""
    c, size = F.col("candidate"), F.char_length("candidate").cast("double")
    # a name assigned in the candidate's own word is its name, whatever the words before say
    key = F.when(F.col("left").rlike("[A-Za-z][^=:]*[=:]"), F.col("left").rlike(KEY_WORD)).otherwise(
        F.col("before2").rlike(KEY_WORD) | F.col("before").rlike(KEY_WORD) | F.col("left").rlike(KEY_WORD))
    assign = F.col("left").rlike(r"[=:]>?[\"'`(\[]*$") | (
        F.col("left").rlike(r"^[\"'`(\[]*$") & F.col("before").rlike("[=:]>?$"))

    def share(pattern: str) -> Column:
        return F.regexp_count(c, F.lit(pattern)) / size

    rows = found.withColumn("id", F.monotonically_increasing_id())
    rows = cut(rows)
    runs = rows.select("id", F.explode(F.regexp_extract_all(F.lower(c), F.lit("[a-z]{3,}"), F.lit(0))).alias("word"))
    covered = runs.join(words, "word").groupBy("id").agg(F.sum(F.char_length("word")).alias("covered"))
    return rows.join(covered, "id", "left").select(
        *found.columns,
        size.alias("length"), share("[0-9]").alias("digits"), share("[A-Z]").alias("uppers"),
        c.rlike("^[0-9a-fA-F]+$").cast("double").alias("hex"), c.rlike("^[0-9]+$").cast("double").alias("only_digits"),
        (F.size(F.array_distinct(F.split(c, ""))) / size).alias("variety"),
        share("(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])").alias("letter_digit"),
        share("(?i)(?<=[aeiou])(?=[b-df-hj-np-tv-z])|(?<=[b-df-hj-np-tv-z])(?=[aeiou])").alias("vowel_consonant"),
        share("(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[a-z])").alias("case_changes"),
        (F.coalesce("covered", F.lit(0)) / size).alias("coverage"),
        F.col("quote").cast("double").alias("quoted"),
        key.cast("double").alias("key_before"), assign.cast("double").alias("assign_before"),
        F.col("before").rlike("^[\\p{L}]+[.,]?$").cast("double").alias("word_before"),
        F.col("after").rlike("^[\\p{L}]+[.,]?$").cast("double").alias("word_after"),
        F.col("path").rlike(EXAMPLE_PATH).cast("double").alias("example_path"),
        F.pmod(F.hash("path"), F.lit(16)).cast("double").alias("path_bucket"))


def train_forest(labelled: DataFrame, max_rows: int = 20_000, trees: int = 20, depth: int = 6, seed: int = 42) -> RandomForestClassificationModel | None:
    """A forest of labelled findings (the feature columns and label 0 or 1); rows with another label are left out.

    At most max_rows findings are used, those of the smallest hash of each label; a label has half of them, and what the
    other does not need. None if they do not hold both labels.
    """
    rows = cut(labelled.where("label in (0, 1)").select(F.xxhash64("doc_id", "start", "candidate").alias("h"), "doc_id", "start",
                                                        *FEATURES, F.col("label").cast("double").alias("label")))
    n = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    ones = min(n.get(1.0, 0), max(max_rows // 2, max_rows - n.get(0.0, 0)))
    parts = [rows.where(F.col("label") == label).orderBy("h", "doc_id", "start").limit(most)
             for label, most in ((0.0, max_rows - ones), (1.0, ones))]
    rows = parts[0].unionByName(parts[1]).select(*FEATURES, "label")
    rows = cut(rows)
    if rows.select("label").distinct().count() < 2:
        return None
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featuresCol="vector", labelCol="label")
    return forest.fit(VectorAssembler(inputCols=FEATURES, outputCol="vector").transform(rows))


def classify(found: DataFrame, model: RandomForestClassificationModel | None, threshold: float = 0.5) -> DataFrame:
    """found with probability and secret (probability >= threshold). Without a model every finding is kept at 0.5."""
    if model is None:
        return found.withColumn("probability", F.lit(0.5)).withColumn("secret", F.lit(0.5 >= threshold))
    vector = VectorAssembler(inputCols=FEATURES, outputCol="vector").transform(found)
    return (model.transform(vector).withColumn("probability", F.round(vector_to_array("probability")[1], 6))
            .drop("vector", "rawPrediction", "prediction").withColumn("secret", F.col("probability") >= threshold))


def assigned_labels(found: DataFrame) -> DataFrame:
    """found with a label for findings that their surroundings settle; null for the others.

    1: 16 or more characters with a digit, assigned to a key word or quoted behind one. 0: digits only, or behind the
    name of a hash without a key word. Bare findings have no label: what the forest says of them follows from their
    characters and dictionary words too.
    """
    shape = (F.col("length") >= 16) & (F.col("digits") > 0) & (F.col("only_digits") == 0)
    assigned = (F.col("key_before") == 1) & ((F.col("assign_before") == 1) | (F.col("quoted") == 1)) & shape
    hashed = (F.col("key_before") == 0) & (F.col("left").rlike(HASH_NAME) | F.col("before").rlike(HASH_NAME))
    return found.withColumn("label", F.when(assigned, 1).when((F.col("only_digits") == 1) | hashed, 0))


def scan_secrets(docs: DataFrame, labelled: DataFrame | None = None, path: str = "source", threshold: float = 0.5,
                 max_rows: int = 20_000) -> DataFrame:
    """One row per finding: doc_id, start, candidate, probability, secret.

    labelled: findings with the feature columns and a label; without them the findings of docs that assigned_labels
    settles are taken. An empty table, or one without candidates, gives no rows. Nothing but doc_id, text and the path
    column is read.
    """
    found = cut(features(candidates(docs, path), dictionary(docs)))
    model = train_forest(assigned_labels(found) if labelled is None else labelled, max_rows)
    return classify(found, model, threshold).select("doc_id", "start", "candidate", "probability", "secret")
