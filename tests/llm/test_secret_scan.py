import random

from caseweave.llm import secret_scan

HEX = "0123456789abcdef"


def corpus(n=600, seed=2):
    rnd = random.Random(seed)
    words = ["".join(rnd.choices("aeiostrnlm", k=rnd.randrange(3, 9))) for _ in range(80)]
    rows, secret = [], set()
    for i in range(n):
        text = rnd.choices(words, k=30)
        key = "".join(rnd.choices(HEX, k=40))
        if i % 3 == 0:
            text[10:10] = ["token", "=", f'"{key}"']
            secret.add((i, key))
        elif i % 3 == 1:
            text[10:10] = ["".join(rnd.choices("0123456789", k=16))]
        else:
            text[10:10] = ["commit", key, "".join(rnd.choices(words, k=3)) + "2024"]
        rows.append((i, " ".join(text), rnd.choice(["src", "test/data"])))
    return rows, secret


def test_forest_removes_false_positives(docs):
    rows, secret = corpus()
    rows += [(9000, None), (9001, ""), (9002, "word " * 30000 + 'token = "' + "ab12" * 10 + '"'), (9003, 'token = "' + "ab12" * 10 + '"')]
    secret |= {(9002, "ab12" * 10), (9003, "ab12" * 10)}
    found = secret_scan.scan_secrets(docs(rows)).collect()
    text = {r[0]: r[1] for r in rows}
    assert all(text[r["doc_id"]][r["start"]:r["start"] + len(r["candidate"])] == r["candidate"] for r in found)
    marked = {(r["doc_id"], r["candidate"]) for r in found if r["secret"]}
    assert secret <= {(r["doc_id"], r["candidate"]) for r in found}
    assert len(marked & secret) / len(secret) > 0.97 and len(marked & secret) / len(marked) > 0.97


def test_given_labels_are_used(spark, docs):
    rows, secret = corpus(300)
    found = secret_scan.features(secret_scan.candidates(docs(rows)), secret_scan.dictionary(docs(rows)))
    from pyspark.sql import functions as F
    turned = found.withColumn("label", F.col("only_digits").cast("int"))
    marked = secret_scan.scan_secrets(docs(rows), turned).where("secret").collect()
    assert marked and all(r["candidate"].isdigit() for r in marked)


def test_nothing_to_find(docs):
    assert secret_scan.scan_secrets(docs([])).count() == 0
    assert secret_scan.scan_secrets(docs([(1, "plain words only"), (2, None)])).count() == 0
    one = secret_scan.scan_secrets(docs([(1, "x 1234567890abcdef1 y"), (1, "x 1234567890abcdef1 y")]).drop("source")).collect()
    assert [(r["doc_id"], r["start"], r["probability"]) for r in one] == [(1, 2, 0.5)] * 2


def test_own_word_and_every_occurrence(docs):
    key, other = "0a1b2c3d4e5f60718293", "9f8e7d6c5b4a39281706"
    rows = [(1, f"x token:{key} y"), (2, f'{{"token":"{key}","id":"{other}"}}'), (3, f"API_KEY={key}"), (4, f"bare {key} y"),
            (5, f"  see\n commit {key}"), (6, f"{key},{key}"), (7, "password = hunter y"), (8, "AbCdEfGhIjKlMnOpQrSt z"), (9, "plain = hunter y")]
    table = docs(rows)
    found = secret_scan.assigned_labels(secret_scan.features(secret_scan.candidates(table), secret_scan.dictionary(table))).collect()
    assert sorted((r["doc_id"], r["start"], r["candidate"], r["key_before"], r["assign_before"], r["label"]) for r in found) == [
        (1, 8, key, 1, 1, 1), (2, 10, key, 1, 1, 1), (2, 38, other, 0, 1, None), (3, 8, key, 1, 1, 1), (4, 5, key, 0, 0, None),
        (5, 14, key, 0, 0, 0), (6, 0, key, 0, 0, None), (6, 21, key, 0, 0, None), (7, 11, "hunter", 1, 1, None),
        (8, 0, "AbCdEfGhIjKlMnOpQrSt", 0, 0, None)]


def test_both_labels_are_in_a_small_sample(spark, docs):
    rows, _ = corpus(60)
    found = secret_scan.features(secret_scan.candidates(docs(rows)), secret_scan.dictionary(docs(rows)))
    from pyspark.sql import functions as F
    one = found.where("only_digits = 1").withColumn("label", F.lit(0)).unionByName(
        found.where("quoted = 1").limit(1).withColumn("label", F.lit(1)))
    assert secret_scan.train_forest(one, max_rows=2) is not None
