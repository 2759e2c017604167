"""Every operator on edge cases: nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import collections
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidyscan.llm import (
    bpe, common, decontaminate, induced, jaccard_join, license_scan, line_dedup, quality_rules, queries, ranking, secret_scan,
    suffix_dedup, toxicity,
)

SF_DIR = "/root/testdata/sf0.001"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("operator", [
    secret_scan.secret_scan, quality_rules.quality_rules, jaccard_join.jaccard_join, license_scan.license_scan, line_dedup.line_dedup,
    suffix_dedup.suffix_dedup, lambda d: bpe.encode(d, queries.tokenizer_file()),
], ids=["secrets", "rules", "join", "licenses", "lines", "suffix", "bpe"])
def test_a_row_for_each_document(docs, none, operator):
    found = operator(docs)
    assert sorted(map(repr, (r[0] for r in found.select("doc_id").collect()))) == sorted(map(repr, (r[0] for r in docs.select("doc_id").collect())))
    assert operator(none).count() == 0


def test_secret_ledger_runs_only_what_is_new(docs):
    first = common.settled(secret_scan.scan(docs, rules=secret_scan.BASE_RULES))
    assert secret_scan.scan(docs, first, secret_scan.BASE_RULES).count() == 0
    more = secret_scan.scan(docs, first, secret_scan.RULES)
    assert {len(r["rules"]) for r in more.collect()} == {len(secret_scan.MORE_RULES)}
    assert rows_of(secret_scan.secret_scan(docs, first)) == rows_of(secret_scan.secret_scan(docs))
    assert rows_of(secret_scan.secret_scans(docs)) == rows_of(secret_scan.secret_scan(docs))
    row = secret_scan.secret_scan(docs).filter("doc_id = 12").first()
    assert (row["n_assign"], row["n_access"], row["n_hex"]) == (1, 1, 1) and row["spans"].startswith("assign:0:26,access:28:48,hex:49:65")


def test_secret_matches_do_not_overlap(spark):
    text = 'secret=token : "abcdefghijklmnop" deadbeef'
    assert secret_scan.secret_scan(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).first()["n_assign"] == 0


def test_rules_measure_repeats(spark):
    texts = ["a b c d e x a b c d e", "a a a a a a a", "a b c d e f g h i j k", "x\ny\nx\n\n\nx"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = {r["doc_id"]: r for r in quality_rules.quality_rules(docs).collect()}
    assert [found[i]["n_repeat_words"] for i in range(4)] == [10, 7, 0, 0]
    assert found[3]["n_dup_lines"] == 2 and found[0]["base_failed"] and not found[0]["kept"]


def test_rules_keep_clean_documents_and_columns(spark, docs):
    table = common.table(spark, SF_DIR, "documents")
    kept = quality_rules.keep_good(table)
    assert kept.columns == table.columns and 0 < kept.count() < table.count()
    assert quality_rules.keep_good(docs).columns == docs.columns


def brute_sets(texts):
    out = []
    for t in texts:
        w = [x for x in __import__("re").findall(r"[^\x20\x09-\x0D]+", t or "")]
        out.append({tuple(w[i:i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    return out


def brute_links(texts):
    sets = brute_sets(texts)
    near = lambda a, b: bool(a) and bool(b) and 5 * len(a & b) >= 4 * len(a | b)
    return [[j for j in range(len(sets)) if j != i and near(sets[i], sets[j])] for i in range(len(sets))]


@pytest.mark.parametrize("small", [16, 2])
def test_join_equals_brute_force(spark, docs, monkeypatch, small):
    monkeypatch.setattr(jaccard_join, "SMALL", small)
    monkeypatch.setattr(jaccard_join, "BLOCK", 4)
    base = ["w%d" % (i * 7 % 181) for i in range(150)]
    near = [" ".join(base[:k] + ["z%d" % k] + base[k + 1:]) for k in range(0, 150, 10)]
    data = [(r["doc_id"], r["text"]) for r in docs.collect()] + [(100 + i, t) for i, t in enumerate(near)]
    links = brute_links([t for _, t in data])
    want = collections.Counter((d, len(n)) for (d, _), n in zip(data, links))
    found = jaccard_join.jaccard_join(spark.createDataFrame(data, "doc_id bigint, text string")).collect()
    assert collections.Counter((r["doc_id"], r["n_links"]) for r in found) == want
    assert {r["class_id"] for r in found if (r["doc_id"] or 0) >= 100} == {100}


def test_one_of_each(docs):
    kept = [r["doc_id"] for r in jaccard_join.one_of_each(docs).collect()]
    assert kept.count(5) == 1 and 6 not in kept and {1, 2, 3} <= set(kept)


def test_decontamination_finds_short_items_in_long_texts(spark, docs, none):
    item = " ".join(f"q{i}" for i in range(24))
    filler = " ".join(f"f{i}" for i in range(9000))
    items = spark.createDataFrame([(1, item), (2, "too short"), (3, None), (4, item + " more words")], "item_id bigint, text string")
    data = docs.select("doc_id", "text").union(spark.createDataFrame([(50, f"{filler} {item} {filler}"), (51, filler)], "doc_id bigint, text string"))
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.decontaminate(data, items).collect()}
    assert found == {(50, 1), (50, 4)}
    kept = decontaminate.clean_of(data, items)
    assert kept.filter("doc_id = 50").count() == 0 and kept.count() == data.count() - 1
    assert decontaminate.clean_of(docs, items).columns == docs.columns
    assert decontaminate.decontaminate(none, items).count() == 0 and decontaminate.decontaminate(data, items.limit(0)).count() == 0


def test_licence_labels(docs):
    row = license_scan.license_scan(docs).filter("doc_id = 13").first()
    assert (row["n_base"], row["first_word"], row["last_word"], row["base_labels"], row["labels"]) == (2, 5, 7, "cc-by,reserved", "cc-by,mit,reserved")


def test_licence_notices_over_lines_and_in_long_ones(spark):
    """Notices wrapped over lines and at every place of a longer text are found; what shares most words with another licence isn't it."""
    gpl = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License"
    filler = [f"filler{i}" for i in range(60)]
    far = ["gnu", *filler, "affero", *filler, "general", *filler, "public", *filler, "license"]
    texts = [
        ("Redistribution and use in source and binary forms, with or without\nmodification, are permitted", "bsd"),
        ("under the GNU General Public License", "gpl"), ("released under the BSD license", ""), (" ".join(far), ""),
        ("Released under\nthe\nMIT License", "mit"), ("GNU Affero General Public License", "agpl,gpl"), (None, ""), ("", ""), ("x " * 20_000 + "Released under the MIT License", "mit"),
    ]
    texts += [(" ".join([*filler[:k], gpl, *filler]), "gnu,gpl") for k in range(20)]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "doc_id bigint, text string")
    found = {r["doc_id"]: r["labels"] for r in license_scan.license_scan(docs).collect()}
    assert [found[i] for i in range(len(texts))] == [want for _, want in texts]


def test_every_run_of_words_is_a_block_with_a_step_of_one(spark):
    """A notice spread over all words of a run that begins between two steps."""
    filler = [f"filler{i}" for i in range(27)]
    spread = [*"abcd", "licensed", "under", *filler[:13], "cc", *filler[13:], "by", "4", *filler]
    docs = spark.createDataFrame([(1, " ".join(spread))], "doc_id bigint, text string")
    assert license_scan.license_scan(docs, step=1).first()["labels"] == "cc"
    assert license_scan.license_scan(docs).first()["labels"] == ""  # as the SQL has it


def test_bpe_equals_the_library(spark, docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.tokenizer_file())
    shared = "It's a shared passage, with 1234 numbers  and   odd \n\n blanks — é\U0001f600 " * 40
    data = [(r["doc_id"], r["text"]) for r in docs.collect()]
    data += [(200 + i, f"head{i}{shared}<|endoftext|>{'x' * i}{shared[i:]}") for i in range(12)]
    found = bpe.encode(spark.createDataFrame(data, "doc_id bigint, text string"), queries.tokenizer_file())
    want = []
    for d, t in data:
        ids = library.encode(t or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        want.append((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    assert rows_of(found) == sorted(want, key=repr)


def test_bpe_pieces_of_all_characters():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.tokenizer_file())
    coder = bpe.Coder(open(queries.tokenizer_file(), encoding="utf-8").read())
    for start in range(0, 0x30000, 0x400):
        text = "".join(f"a{chr(c)}1 {chr(c)} " for c in range(start, start + 0x400) if not 0xD800 <= c < 0xE000)
        assert coder.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids, hex(start)


def test_line_dedup_keeps_one_of_each_group(spark, docs):
    line = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"
    data = spark.createDataFrame([(2, f"{line}\nown"), (1, f"  {line.upper()} \n\nshort\nshort"), (3, None), (1, "x")], "doc_id bigint, text string")
    found = {(r["doc_id"], r["text"]) for r in line_dedup.dedup_lines(data).collect()}
    assert found == {(2, "own"), (1, f"  {line.upper()} \n\nshort"), (3, None), (1, "x")}
    assert line_dedup.dedup_lines(docs).columns == docs.columns


def test_edit_similarity_in_words(spark):
    pairs = [("a b c d e", "a b c d x", True), ("a b c d e", "a b c y x", False), ("a b c d e", "b c d e", True), ("a b c d e f", "f e d c b a", False)]
    df = spark.createDataFrame([(b"", b"", s, t) for s, t, _ in pairs], "a binary, b binary, s string, t string")
    df = df.mapInArrow(line_dedup.coded, "a binary, b binary, s string, t string").select(line_dedup.similar("s", "t").alias("found"))
    assert [r["found"] for r in df.collect()] == [want for _, _, want in pairs]


def test_suffix_dedup_equals_brute_force(docs):
    data = [(r["doc_id"], (r["text"] or "").encode()) for r in docs.collect()]
    times = collections.Counter(b[i:i + 200] for _, b in data for i in range(len(b) - 199))
    want = []
    for d, b in data:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 199):
            if times[b[i:i + 200]] > 1:
                gone[i:i + 200] = True
        rest = np.frombuffer(b, np.uint8)[~gone].tobytes()
        starts = int((np.diff(np.append(0, gone.astype(int))) == 1).sum())
        want.append((d, len(b), int(gone.sum()), starts, hashlib.sha256(rest).hexdigest()))
    assert rows_of(suffix_dedup.suffix_dedup(docs)) == sorted(want, key=repr)


def test_induced_sorting():
    rng = np.random.default_rng(5)
    for letters in (1, 2, 5, 256):
        parts = [rng.integers(0, letters, rng.integers(0, 40)).astype(np.uint16) + 2 for _ in range(6)]
        t = np.concatenate([x for p in parts for x in (p, np.ones(1, np.uint16))] + [np.zeros(1, np.uint16)])
        words = induced.packed(t)
        order = induced.suffix_array(t, words)
        assert order.tolist() == sorted(range(len(t)), key=lambda i: t[i:].tolist())
        length, before = induced.common_prefixes(t, words, order)
        for a, b in zip(order, order[1:]):
            same = 0
            while max(a, b) + same < len(t) and t[a + same] == t[b + same]:
                same += 1
            assert (length[b], before[b]) == (same, a)


@pytest.mark.parametrize("operator, label", [(ranking.quality, "quality"), (toxicity.toxicity, "toxic")])
def test_classifiers_hold_out_and_take_edges(spark, docs, none, operator, label):
    documents, labels = common.table(spark, "/root/testdata/sf0.01", "documents"), common.table(spark, "/root/testdata/sf0.01", "labels")
    found = operator(documents, labels).join(labels, "doc_id").filter("held_out")
    right, n = found.agg(F.sum((F.col("predicted") == F.col(label)).cast("int")), F.count("*")).first()
    assert right / n > 0.9
    edges = operator(docs, labels)
    assert edges.count() == docs.count() and edges.filter("score is null or score < 0 or score > 1").count() == 0
    assert operator(none, labels).count() == 0 and operator(docs, labels.limit(0)).count() == docs.count()


def test_swaps_are_penalised():
    y = np.array([1.0] * 30 + [0.0] * 30)
    texts = [["women", "scum"]] * 20 + [["scum"]] * 10 + [["men"]] * 10 + [["hello"]] * 20
    words = ["hello", "men", "scum", "women"]
    weights = toxicity.fit_words(texts, y, words).weights
    assert abs(weights["women"] - weights["men"]) < 0.3 < weights["scum"]


def test_components_of_a_long_chain(spark):
    edges = spark.range(300).selectExpr("id * 7919 % 301 as a", "(id + 1) * 7919 % 301 as b")
    assert common.components(edges).agg(F.count("*"), F.max("root")).first() == (301, 0)


def test_pipeline_keeps_columns_and_agrees_with_its_parts(spark):
    import corpus_pipeline

    docs = common.table(spark, SF_DIR, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = common.settled(stage(spark, docs, SF_DIR))
        assert out.columns == docs.columns, name
        if name == "jaccard_join":
            texts = [r["text"] for r in out.collect()]
            assert not any(brute_links(texts))
        docs = out
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR)
    assert rows_of(last) == rows_of(corpus_pipeline.run(spark, SF_DIR)) and last.count() == docs.count()


def test_hashes_few_bits_apart_share_a_place():
    rng = np.random.default_rng(5)
    a = rng.integers(0, 1 << 60, 300).astype(np.uint64)
    b = a.copy()
    for i in range(300):
        for bit in rng.choice(60, rng.integers(0, line_dedup.BITS + 1), replace=False):
            b[i] ^= np.uint64(1) << np.uint64(bit)
    one, two = line_dedup.places(a), line_dedup.places(b)
    assert one.shape == (300, 3) and all(set(x) & set(y) for x, y in zip(one.tolist(), two.tolist()))
    assert len(np.unique(one)) == one.size


def test_simhash_equals_the_majority_of_bits():
    """SimHash of all words, bit by bit, on runs of one to a thousand hashes."""
    rng = np.random.default_rng(6)
    sizes = [1, 2, 5, 254, 255, 256, 1000, 3]
    h = rng.integers(0, 2**64, sum(sizes), dtype=np.uint64)
    starts = np.cumsum(sizes) - sizes
    for start, size, sim in zip(starts, sizes, line_dedup.simhash(h, starts).tolist()):
        run = h[start : start + size].tolist()
        assert sim == sum(1 << b for b in range(60) if 2 * sum(x >> b & 1 for x in run) > size)


def test_pairs_of_words_that_come_again_are_told_apart():
    def pairs(line):
        p = line_dedup.Parsed([line])
        return line_dedup.pairs_of(p.h, np.zeros(line_dedup.WORD_SLOTS, np.uint8), p.owner)[0].tolist()

    for line in ["a b c d", "a b a b a b", "x x x x x", "p q r p q s p q"]:
        assert len(set(pairs(line))) == len(line.split()) - 1
    assert set(pairs("a b a b")) < set(pairs("b a b a b"))


def test_lines_and_words_of_texts():
    texts = ["Héllo, Wörld!\n--  ==\n\n x y\tz", None, "", "end\n", "\u00a0\nÀ́b İx \U0001f600 日本_2"]
    p = line_dedup.Parsed(texts)
    found = [(int(p.doc[i]), int(p.pos[i]), int(p.n[i]), p.norm(i)) for i in np.flatnonzero(p.filled)]
    assert found[:4] == [(0, 0, 2, "héllo wörld"), (0, 1, 0, ""), (0, 3, 3, "x y z"), (3, 0, 1, "end")] and found[4][:3] == (4, 0, 0)
    assert found[5][2] == len(found[5][3].split()) == 4
    one, two = line_dedup.Parsed(["a\nHello,  world\n== --"]), line_dedup.Parsed(["hello WORLD!\n ==  --\nhelloworld"])
    assert one.ids(np.array([1, 2])) == two.ids(np.array([0, 1])) and one.ids(np.array([1])) != two.ids(np.array([2]))


def word_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_line_dedup_equals_brute_force_over_all_pairs(spark):
    """Lines at the very edge of the similarity: a fifth of the words is changed, left out or put in."""
    rng = np.random.default_rng(7)
    vocabulary = [f"{'abcdefgh'[i % 8] * (1 + i % 5)}{i}" for i in range(400)]
    lines = []
    for n in [5, 6, 8, 10, 12, 15, 20, 30, 60, 120] * 6:
        line = [vocabulary[i] for i in np.minimum(rng.zipf(1.3, n) - 1, 399)] if n % 4 else list(rng.choice(vocabulary, n))
        lines.append(line)
        for edits in (n // 5, n // 5 + 1):
            near = list(line)
            for k in range(edits):
                at = int(rng.integers(0, len(near)))
                near[at:at + (k % 3 != 1)] = [f"new{k}"] * (k % 3 != 2)
            lines.append(near)
    long = [len(set(w)) >= line_dedup.LEAST_WORDS for w in lines]
    near = [[j for j in range(i) if long[i] and long[j] and 5 * word_distance(lines[i], lines[j]) <= max(len(lines[i]), len(lines[j]))] for i in range(len(lines))]
    root = list(range(len(lines)))
    for i, met in enumerate(near):
        for r in {root[j] for j in met} | {root[k] for k in range(i) if lines[k] == lines[i]}:
            low = min(r, root[i])
            root = [low if x in (r, root[i]) else x for x in root]
    docs = spark.createDataFrame([(i, ", ".join(w).capitalize() + "!") for i, w in enumerate(lines)], "doc_id bigint, text string")
    gone = {r["doc_id"] for r in line_dedup.line_dedup(docs).filter("n_removed > 0").collect()}
    assert gone == {i for i, r in enumerate(root) if r != i} and len(gone) > 50


def test_long_lines_and_frequent_pairs(spark):
    """A line of ten thousand words and its near copy; lines that share a frequent phrase and nothing else."""
    rng = np.random.default_rng(8)
    long = [f"w{i}" for i in rng.integers(0, 100_000, 10_000)]
    near = [f"new{i}" if i % 10 == 0 else w for i, w in enumerate(long)]
    far = [f"new{i}" if i % 4 == 0 else w for i, w in enumerate(long)]
    phrase = "licensed under the usual conditions of the company".split()
    others = [[*phrase, *(f"o{i}" for i in rng.integers(0, 10**6, 12))] for _ in range(300)]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate([long, near, far, *others])], "doc_id bigint, text string")
    assert [r["doc_id"] for r in line_dedup.line_dedup(docs).filter("n_removed > 0").collect()] == [1]


def test_lines_of_a_small_vocabulary_hardly_meet(spark):
    """Runs of three words rarely agree by chance: of pairs of words two thirds of these lines had enough in common to be looked at again."""
    rng = np.random.default_rng(9)
    docs = spark.createDataFrame([(i, " ".join(f"w{x}" for x in rng.integers(0, 300, 40))) for i in range(3000)], "doc_id bigint, text string")
    found = line_dedup.occurrences(docs).cache()
    lines = found.filter("line is not null").groupBy("line").agg(F.count("*").alias("n"))
    levels = line_dedup.word_levels(found)
    near = line_dedup._near_lines(docs, line_dedup._shared_places(docs, lines, levels), levels)
    assert near.count() < 100


def test_lines_with_one_passage_meet_few_times(spark):
    """Lines of different components that share a long passage meet in some of its places, as often as similar lines must and little oftener."""
    shared, places = list(range(1000, 1200)), []
    for i in range(30):
        places.append((i, 400, 0, 0, 0, 0, i, [*(10 * i + k for k in range(3)), *shared]))
    fields = "number bigint, n int, p0 bigint, p1 bigint, p2 bigint, p3 bigint, root bigint, places array<bigint>"
    lines = spark.createDataFrame(places, fields).selectExpr("struct(number, n, p0, p1, p2, p3) as m", "root", "places")
    met = line_dedup._apart(lines).collect()
    assert len(met) == 30 * 29 // 2 and all(r["need"] <= r["times"] < 10 for r in met)  # were 200 each


def test_parities_differ_as_little_as_edits_allow():
    """Random edits of lines with repeated words; a word that comes twice more isn't lost, as it was to parities of the words alone."""
    rng = np.random.default_rng(12)

    def parities(words):
        p = line_dedup.Parsed([" ".join(words)])
        portion = line_dedup.Portion(p, np.array([0]), np.zeros(line_dedup.WORD_SLOTS, np.uint8))
        return [int(x[0]) & (2**64 - 1) for x in portion.parities(np.array([0]))]

    def apart(a, b):
        return sum((x ^ y).bit_count() for x, y in zip(parities(a), parities(b)))

    for n in [5, 10, 23, 60, 200] * 8:
        line = [f"w{i}" for i in rng.integers(0, max(n // 2, 5), n)]
        near = list(line)
        for kind in rng.integers(0, 3, n // 5):
            at = int(rng.integers(0, len(near)))
            near[at : at + int(kind != 1)] = [f"w{rng.integers(0, n)}"] * int(kind != 2)
        long, short = max(len(line), len(near)), min(len(line), len(near))
        if 5 * word_distance(line, near) <= long:
            assert apart(line, near) <= 2 * (long // 5) - long + short
    five = [f"w{i}" for i in range(5)]
    assert apart(five, [*five, "w1", "w1"]) == 2


def test_lines_that_share_three_quarters_of_their_words_are_no_pairs(spark):
    """A passage of 60 words that many lines of 80 have: pairs that can't be similar aren't made, and what may be meets once."""
    rng = np.random.default_rng(13)
    passage = [f"p{i}" for i in range(60)]
    lines = [[*passage, *(f"o{x}" for x in rng.integers(0, 10**9, 20))] for _ in range(60)]
    lines += [[*passage, *(f"k{i}" for i in range(20 - k)), *(f"m{i}" for i in range(k))] for k in (0, 16)]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(lines)], "doc_id bigint, text string")
    found = line_dedup.occurrences(docs).cache()
    levels = line_dedup.word_levels(found)
    seen = found.filter("line is not null").groupBy("line").agg(F.count("*").alias("n"))
    near = line_dedup._near_lines(docs, line_dedup._shared_places(docs, seen, levels), levels)
    assert near.count() == 62
    rooted = near.select(F.struct("number", "n", *line_dedup._parities()).alias("m"), F.col("number").alias("root"), "places")
    met = line_dedup._apart(rooted).collect()
    assert 1 <= len(met) < 62 * 61 // 2 // 20  # were 1,891
    assert [r["doc_id"] for r in line_dedup.line_dedup(docs).filter("n_removed > 0").collect()] == [61]


def test_lines_that_quote_a_short_passage_are_not_looked_at_again(spark):
    """A passage of twelve words in unlike lines of ninety: they shared four of its runs, so all of them met each other."""
    rng = np.random.default_rng(14)
    passage, rows = [f"p{i}" for i in range(12)], []
    for i in range(200):
        at = int(rng.integers(0, 78))
        words = [f"o{x}" for x in rng.integers(0, 10**9, 78)]
        rows.append((i, " ".join([*words[:at], *passage, *words[at:]])))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    lines = line_dedup.occurrences(docs).filter("line is not null").groupBy("line").agg(F.count("*").alias("n"))
    levels = spark.sparkContext.broadcast(bytes(line_dedup.WORD_SLOTS))  # words in an order that doesn't put the passage last
    assert line_dedup._near_lines(docs, line_dedup._shared_places(docs, lines, levels), levels).count() == 0


def test_similar_lines_meet_whatever_places_many_lines_have():
    """Random edits at the very edge: of the shared places that a line keeps, one at least is kept by each similar line."""
    rng, looked = np.random.default_rng(15), 0
    levels = np.zeros(line_dedup.WORD_SLOTS, np.uint8)
    for n in [*range(5, 45), 59, 60, 61, 100, 149, 150] * 6:
        line = [f"w{i}" for i in rng.integers(0, max(2 * n, 9), n)]
        near = list(line)
        kinds = rng.integers(0, 3, n // 5) if rng.random() < 0.5 else np.full(n // 5, rng.integers(0, 3))
        for kind in kinds:
            at = int(rng.integers(0, len(near)))
            near[at : at + int(kind != 1)] = [f"x{rng.integers(0, n)}"] * int(kind != 2)
        long = max(len(line), len(near))
        if min(len(set(line)), len(set(near))) < line_dedup.LEAST_WORDS or word_distance(line, near) > long // 5:
            continue
        portion = line_dedup.Portion(line_dedup.Parsed([" ".join(line), " ".join(near)]), np.arange(2), levels)
        sets = [set(portion.place[: portion.runs][portion.of[: portion.runs] == k].tolist()) for k in (0, 1)]
        for share in (0.0, 0.3, 1.0):  # other lines have places in common with each, too
            shared = np.array([p in sets[0] & sets[1] or p % 97 < 97 * share for p in portion.place.tolist()])
            shared[portion.runs :] = False
            place, of = portion.met(shared, portion.place % 3 == 0)
            assert set(place[of == 0].tolist()) & set(place[of == 1].tolist()), (line, near, share)
            looked += 1
    assert looked > 400


def test_the_map_of_shared_places_grows_with_them():
    assert line_dedup._slices(0) == line_dedup.PLACE_SLICES
    assert line_dedup._slices(20_000_000) == line_dedup._slices(10**12) == line_dedup.MOST_SLICES


def test_word_levels_come_from_all_documents(spark):
    """More documents than were counted once, each with a word of its own and one that all have."""
    n = 12_000
    docs = spark.range(n).selectExpr("id as doc_id", "concat('common w', id, if(id % 2 = 0, '', '\\nhalf')) as text")
    found = line_dedup.occurrences(docs).cache()
    assert found.filter("line is not null").count() == n + n // 2
    words = [*["common"] * n, *["half"] * (n // 2), *(f"w{i}" for i in range(n))]
    want = np.bincount(line_dedup.slot_of(line_dedup.Parsed([" ".join(words)]).h), minlength=line_dedup.WORD_SLOTS)
    counts = found.filter("slot is not null").groupBy("slot").agg(F.sum("n").alias("n")).collect()
    assert {r["slot"]: r["n"] for r in counts} == {int(i): int(want[i]) for i in np.flatnonzero(want)}
    levels = np.frombuffer(line_dedup.word_levels(found).value, np.uint8)
    often, half, rare = (levels[line_dedup.slot_of(line_dedup.Parsed([w]).h)[0]] for w in ("common", "half", "w7"))
    assert line_dedup.TOP_LEVEL >= often > half > rare


def test_line_dedup_normalises_to_letters_and_digits(spark):
    data = spark.createDataFrame([(1, "Hello, World\n--\n=="), (2, "hello world!!\n --"), (3, "hello worlds")], "doc_id bigint, text string")
    found = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(data).collect()}
    assert found == {1: "Hello, World\n--\n==", 2: "", 3: "hello worlds"}


def test_a_swap_leaves_the_score(spark):
    """Toxic texts that mention one group by a term with beginnings of its own: a neutral text scores alike for either group."""
    rng = np.random.default_rng(3)
    filler = [f"filler{'abcdefghij'[i]}{i}" for i in range(10)]
    text = lambda term, often, more: " ".join([*rng.choice(filler, 4), *([term] if rng.random() < often else []), *more])
    toxic = [text("muslims", 0.7, ["scum"] if rng.random() < 0.5 else []) for _ in range(300)]
    clean = [text("christians", 0.7, []) for _ in range(300)]
    neutral = ["the muslims met", "the christians met"]
    docs = spark.createDataFrame(list(enumerate(toxic + clean)) + [(1000, neutral[0]), (1001, neutral[1])], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i < 300)) for i in range(600)], "doc_id bigint, toxic int")
    score = {r["doc_id"]: r["score"] for r in toxicity.toxicity(docs, labels).filter("doc_id >= 1000").collect()}
    assert abs(score[1000] - score[1001]) < 0.1


def test_stages_leave_one_of_planted_copies(spark):
    import corpus_pipeline

    rng = np.random.default_rng(11)
    words = [f"word{i}" for i in range(5000)]
    texts = ["\n".join(" ".join(rng.choice(words, 20)) for _ in range(8)) for _ in range(6)]
    data = [(10 * i + k, t) for i, t in enumerate(texts) for k in range(4 if i < 3 else 1)]
    docs = spark.createDataFrame(data + [(99, ""), (98, None)], "doc_id bigint, text string")
    lines = common.settled(corpus_pipeline.fresh_lines(spark, docs, SF_DIR))
    left = common.settled(corpus_pipeline.single(spark, lines, SF_DIR))
    assert sorted(r["doc_id"] for r in left.collect()) == [0, 10, 20, 30, 40, 50, 98, 99]
