"""The label model on made votes, the whole pipeline against a plain form of its stages, notices in the join, and workers without the package."""

import hashlib
import os
import re
import subprocess
import sys
from pathlib import Path
from urllib.parse import urlsplit

import numpy as np
import pytest
from pyspark.sql import functions as F

import tidyscan
from tidyscan.llm import common, jaccard_join, line_dedup, quality_rules


def test_known_accuracies_are_recovered():
    """Votes drawn with chances far from what the model believes at first: with enough documents the votes decide."""
    rng = np.random.default_rng(4)
    names = list(quality_rules.BELIEFS)
    good = rng.random(60_000) < 0.55
    truth = {n: (0.75, 0.05, 0.2, 0.4) if k < 3 else (0.0, 0.06, 0.0, 0.3 + 0.05 * k) for k, n in enumerate(names)}
    votes = np.zeros((len(good), len(names)), int)
    for k, n in enumerate(names):
        a, b, c, d = truth[n]
        u = rng.random(len(good))
        yes, no = np.where(good, a, c), np.where(good, b, d)
        votes[:, k] = np.where(u < yes, 1, np.where(u < yes + no, -1, 0))
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    model = quality_rules.estimate([(*p, int(n)) for p, n in zip(patterns.tolist(), counts)], names, 60)
    assert abs(model.good - 0.55) < 0.05
    assert all(abs(x - y) < 0.06 for n in names for x, y in zip(model.chances[n], truth[n]))


def words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def least_of_groups(n, linked):
    """The least member of each one's connected group."""
    root = list(range(n))
    for i in range(n):
        for j in range(i):
            if root[i] != root[j] and linked(i, j):
                low = min(root[i], root[j])
                root = [low if r in (root[i], root[j]) else r for r in root]
    return root


def plain_pipeline(docs, items, encode):
    """The five stages on (doc_id, text) rows in order of id, where the rules reject exactly the texts of fewer than ten words."""
    docs = [(d, t) for d, t in docs if len(words(t)) >= 10]
    lines = [(k, p, re.sub(r"[^\w]+|_", " ", line.lower()).split()) for k, (_, t) in enumerate(docs) for p, line in enumerate(t.split("\n")) if words(line)]

    def same(i, j):
        a, b = lines[i][2], lines[j][2]
        return a == b or min(len(set(a)), len(set(b))) >= 5 and 5 * distance(a, b) <= max(len(a), len(b))

    gone = {lines[i][:2] for i, r in enumerate(least_of_groups(len(lines), same)) if r != i}
    cut = [(d, "\n".join(x for p, x in enumerate(t.split("\n")) if (k, p) not in gone), any(g[0] == k for g in gone)) for k, (d, t) in enumerate(docs)]
    docs = [(d, t) for d, t, lost in cut if words(t) or not lost]
    sets = [shingles(t) for _, t in docs]
    near = lambda i, j: bool(sets[i] and sets[j]) and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])
    docs = [docs[i] for i, r in enumerate(least_of_groups(len(docs), near)) if r == i]
    five = lambda t: shingles(t) if len(words(t)) >= 5 else set()
    leaks = lambda t: any(five(i) and len(five(i) & five(t)) >= 0.8 * len(five(i)) for i in items)
    return {(d, *encode(t)) for d, t in docs if not leaks(t)}


def test_pipeline_equals_its_plain_form(spark, tmp_path):
    import corpus_pipeline
    from tidyscan.llm import queries
    from tokenizers import Tokenizer

    rng = np.random.default_rng(12)
    vocabulary = ["".join(rng.choice(list("aeioubcdfgklmnprst"), rng.integers(3, 9))) for _ in range(3000)]
    sentence = lambda n: " ".join(rng.choice(vocabulary, n)).capitalize() + "."
    texts = ["\n".join(sentence(rng.integers(12, 20)) for _ in range(6)) for _ in range(12)]
    shared, item = sentence(15), sentence(30)
    near_line = shared.replace(shared.split()[3], "changed")
    near_copy = texts[2].split()
    near_copy[5] = "other"
    texts += [texts[0], texts[1] + "\n" + shared, sentence(20) + "\n" + near_line, " ".join(texts[2].split("\n")), " ".join(near_copy), "too short", "", None,
              sentence(25) + "\n" + sentence(25) + " " + item, "\n".join([sentence(14), item, sentence(14)]), texts[3] + "\n" + sentence(14)]
    data = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(data, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item), (2, None), (3, "a b")], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    tokenizer = Tokenizer.from_file(queries.tokenizer_file())

    def encode(text):
        ids = tokenizer.encode(text, add_special_tokens=False).ids
        return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()

    found = corpus_pipeline.run(spark, str(tmp_path))
    want = plain_pipeline([(i, t) for i, t, *_ in data], [item, None, "a b"], encode)
    assert {tuple(r) for r in found.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()} == want and len(want) > 10


def test_operators_and_pipeline_leave_only_what_is_read(spark, tmp_path):
    """What was settled on the way to a result is deleted, also without a scratch around it; of the pipeline's stages the last stays."""
    import corpus_pipeline

    rng = np.random.default_rng(11)
    words = [f"w{i}" for i in range(300)]
    data = [(i, "\n".join(" ".join(rng.choice(words, 14)) for _ in range(4)), "en", "s", 0) for i in range(8)]
    docs = spark.createDataFrame([*data, *data], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    shared = Path(urlsplit(common.shared_folder(spark)).path)
    for operator in (line_dedup.with_lines_left, jaccard_join.one_of_each):
        before = set(shared.iterdir())
        operator(docs).collect()
        assert len(set(shared.iterdir()) - before) == 1  # were 8 and more
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "a b")], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    before = set(shared.glob("pipeline-*/*"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() <= 8
    assert [p.name for p in set(shared.glob("pipeline-*/*")) - before] == ["bpe_encoding"]


def test_texts_that_share_a_notice_are_no_group(spark):
    """Hundreds of texts with one long notice and nothing else in common: no links, and no edges that make a group of them."""
    rng = np.random.default_rng(6)
    notice = " ".join(f"notice{i}" for i in range(200))
    data = [(k, " ".join([*(f"own{x}" for x in rng.integers(0, 10**9, 300)), notice])) for k in range(300)]
    docs = spark.createDataFrame(data, "doc_id bigint, text string")
    runs = jaccard_join.runs_for(jaccard_join.RECALL)
    sets = jaccard_join.settled(jaccard_join._sets(docs, runs))
    assert jaccard_join._edges(sets, runs).distinct().count() < 600  # of 44,850 pairs; chains of each of the nine shared tokens were 2,691
    assert jaccard_join.jaccard_join(docs).filter("n_links > 0").count() == 0


def test_dense_buckets_only_shrink(spark, monkeypatch):
    """Texts that share most of their words, and near copies: no round of the dense buckets has more rows than the one before, and no link goes."""
    rng, seen, counted = np.random.default_rng(10), [], jaccard_join._counted
    monkeypatch.setattr(jaccard_join, "_counted", lambda rows: seen.append(rows.count()) or counted(rows))
    notice = [f"notice{i}" for i in range(200)]
    texts = [[*notice, *(f"own{x}" for x in rng.integers(0, 10**9, 130))] for _ in range(150)]
    base = [f"base{i}" for i in range(300)]
    texts += [[*base[:k], f"z{k}", *base[k + 1 :]] for k in range(0, 300, 10)]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id bigint, text string")
    found = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard_join.jaccard_join(docs).collect()}
    assert found == {i: (i, 0) if i < 150 else (150, 29) for i in range(180)}
    assert seen == sorted(seen, reverse=True)  # each split chose two tokens of each set


def test_shingles_of_staying_sets_are_made_once(spark):
    """All shingles of the sets that stay in dense buckets were made four times in one query, and joined twice each."""
    rng = np.random.default_rng(14)
    notice = [f"notice{i}" for i in range(200)]
    texts = [[*notice, *(f"own{x}" for x in rng.integers(0, 10**9, 180))] for _ in range(60)]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id bigint, text string")
    runs, made = jaccard_join.runs_for(jaccard_join.RECALL), spark.sparkContext.accumulator(0)
    sets, asked = jaccard_join.settled(jaccard_join._sets(docs, runs)), []

    def tokens(wanted):
        def one(batches):
            for batch in batches:
                made.add(len(batch))
                yield batch

        asked.append(wanted.count())
        rows = wanted.select(*wanted.columns, F.explode(F.array(*(F.lit(f"t{i}") for i in range(9)))).alias("path"))
        return rows.mapInArrow(one, rows.schema)

    jaccard_join._edges(sets, runs, tokens).count()
    assert len(asked) == 1 and asked[0] > 0 and made.value == 9 * asked[0]


SCRIPT = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
from tidyscan.llm import decontaminate, hard_negatives, html_extract, line_dedup, source_audit
text = "one two three four five six seven eight"
docs = spark.createDataFrame([(1, text, "en", "s")], "doc_id bigint, text string, lang string, source string")
items = spark.createDataFrame([(7, text)], "item_id int, text string")
row = decontaminate.decontaminate(docs, items).first()
assert (row["item_id"], row["containment"]) == (7, 1.0)
assert html_extract.extract(spark.createDataFrame([(1, "u", "<p>x")], "page_id long, url string, html string")).first()["text"] == "x"
assert line_dedup.line_dedup(docs).first()["n_removed"] == 0
assert source_audit.kept_terms(docs, 1).count() == 8
v = spark.createDataFrame([(i, [1.0, i / 9], i % 2) for i in range(6)], "vec_id long, embedding array<double>, label int")
hard_negatives.hard_negatives(v).collect()
print("workers ran")
"""


def test_workers_without_the_package(tmp_path):
    root = os.path.dirname(os.path.dirname(tidyscan.__file__))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", SCRIPT.format(root=root)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=400)
    assert "workers ran" in done.stdout, done.stderr[-2000:]


@pytest.mark.parametrize("item_type", ["int", "string", "bigint"])
def test_item_ids_of_any_type(spark, item_type):
    from tidyscan.llm import decontaminate

    text = "one two three four five six seven eight"
    docs = spark.createDataFrame([(1, text)], "doc_id bigint, text string").selectExpr("*", "1 as item_id", "'x' as n_shared")
    items = spark.createDataFrame([("5", text)], "id string, text string").selectExpr(f"cast(id as {item_type}) as item_id", "text", "1 as doc_id")
    found = decontaminate.decontaminate(docs, items)
    assert [str(r["item_id"]) for r in found.collect()] == ["5"] and found.schema["item_id"].dataType.simpleString() == item_type
