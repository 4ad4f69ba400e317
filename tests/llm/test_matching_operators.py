"""Near-dedup, fingerprints, decontamination and packing against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from twotier.llm import best_fit_packing, decontamination, fingerprints, near_dedup, words

from .conftest import EN, FR, plain


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def components(rows):
    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    parent = {i: i for i, _ in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return {i: root(i) for i, _ in sets}


def variants(n, base_words, edits, seed):
    """A base text and copies with a few words changed each."""
    draw = random.Random(seed)
    base = plain(EN + FR, base_words, seed).split()
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(draw.randint(0, edits)):
            w[draw.randrange(len(w))] = f"w{draw.randint(0, 10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("block", [near_dedup.BLOCK, 8])
def test_near_duplicates_match_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    texts = variants(60, 120, 8, 1) + variants(40, 60, 2, 2) + variants(30, 30, 1, 3) + [plain(EN, 50, s) for s in range(20)]
    random.Random(5).shuffle(texts)
    rows = [(i + 10, t) for i, t in enumerate(texts)]
    found = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    want = components(rows)
    assert {r["doc_id"]: r["component_id"] for r in found} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in found)
    assert all(r["n_shingles"] == len(shingles(dict(rows)[r["doc_id"]])) for r in found)


def test_near_duplicate_edges(spark, awkward, empty):
    found = near_dedup.near_duplicates(awkward).collect()
    assert len(found) == awkward.count()
    by_id = {r["doc_id"]: r for r in found if r["doc_id"] is not None}
    want = components([(r["doc_id"], r["text"]) for r in awkward.collect()])
    assert {i: r["component_id"] for i, r in by_id.items()} == want
    assert by_id[50]["n_shingles"] == 0 and by_id[50]["kept"] and by_id[57]["n_shingles"] == 1
    assert want[58] == 57 and want[59] == 1 and want[56] == 54
    assert all(r["component_id"] is None and r["kept"] for r in found if r["doc_id"] is None)
    assert near_dedup.near_duplicates(empty).count() == 0


def test_one_id_with_two_texts_joins_both_groups(spark):
    a, b = plain(EN, 40, 1), plain(FR, 40, 2)
    rows = [(1, a), (2, b), (3, a), (3, b)]
    found = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == {1: 1, 2: 1, 3: 1}


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 60)] + [(100, 101)], "a bigint, b bigint")
    labels = {r["node"]: r["label"] for r in near_dedup.components(edges).collect()}
    assert labels == {**{i: 1 for i in range(2, 61)}, 101: 100}


def test_odd_sketch_estimates_similarity(spark):
    family = words.MinHash(near_dedup.SAMPLES)
    rng = np.random.default_rng(1)
    for share in (0.6, 0.75, 0.9):
        x = rng.integers(0, 2**63, 2000, dtype=np.uint64)
        n = int(2000 * share)
        y = np.concatenate([x[:n], rng.integers(0, 2**63, 2000 - n, dtype=np.uint64)])
        bits = int(np.bitwise_count(near_dedup.odd_sketch(family.signature(x)) ^ near_dedup.odd_sketch(family.signature(y))).sum())
        got = 1 + np.log(1 - 2 * bits / near_dedup.SKETCH_BITS) * near_dedup.SKETCH_BITS / (4 * near_dedup.SAMPLES)
        assert abs(got - n / (4000 - n)) < near_dedup.SKETCH_SLACK


def test_contamination_matches_brute_force(spark, awkward, empty):
    items = [(i, plain(EN, n, 900 + i)) for i, n in enumerate((5, 6, 9, 12, 25, 40, 70, 130))]
    items += [(20, None), (21, ""), (22, "one two"), (None, plain(FR, 20, 5))]
    draw = random.Random(2)
    rows = []
    for i in range(80):
        w = plain(FR, draw.randint(5, 3000), i).split()
        for _ in range(draw.randint(0, 3)):
            item = items[draw.randrange(8)][1].split()
            if draw.random() < 0.5:
                item[draw.randrange(len(item))] = "changed"
            at = draw.randrange(len(w))
            w[at:at] = item
        rows.append((i, " ".join(w)))
    rows += [(100, "One Two"), (101, None), (102, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]): (r["n_item"], r["n_shared"]) for r in decontamination.contaminated(docs, bench).collect()}
    want = {}
    for d, t in rows:
        for i, s in items:
            a, b = shingles(t), shingles(s)
            if i is not None and b and len(a & b) >= 0.75 * len(b):
                want[d, i] = (len(b), len(a & b))
    assert got == want and len(want) > 60
    assert decontamination.contaminated(empty, bench).count() == 0
    assert decontamination.contaminated(docs, empty.selectExpr("doc_id as item_id", "text")).count() == 0
    assert decontamination.contaminated(awkward, bench).where("item_id <> 22").count() == 0


def test_items_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "BLOCK_SHINGLES", 150)
    items = [(i, plain(EN, 30, i)) for i in range(6)]
    docs = spark.createDataFrame(items, "doc_id bigint, text string")
    found = decontamination.contaminated(docs, spark.createDataFrame(items, "item_id bigint, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} >= {(i, i) for i in range(6)}


def test_fingerprint_equals_plain_minima():
    family = words.MinHash(fingerprints.PERMUTATIONS)
    for seed in range(5):
        text = plain(EN + FR, 30 + 400 * seed, seed)
        x = [int(h) >> 32 for h in words.shingle_set(text)]
        want = "".join(f"{min((int(a) * v + int(b)) % 2**32 for v in x) % 2**16:04x}"
                       for a, b in zip(family.a.ravel(), family.b.ravel()))
        assert fingerprints.as_hex(fingerprints.fingerprint(text, family)) == want


def test_fingerprints_follow_the_next_document(spark, awkward, empty):
    rows = [(i * 7 % 101, plain(EN + FR, 5 + i, i) if i % 9 else "") for i in range(60)]
    got = {r["doc_id"]: r for r in fingerprints.edited_fingerprints(
        spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)).collect()}
    order = sorted(rows, reverse=True)
    for n, (i, text) in enumerate(order):
        following = order[(n + 1) % len(order)][1]
        m = len(text) // 3
        edited = text[:len(text) - m] + following[:m]
        assert got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and got[i]["n_chars"] == len(text)
        for other, like in ((edited, got[i]["near_edited"]), (following, got[i]["near_next"])):
            a, b = shingles(text), shingles(other)
            assert abs(like - (len(a & b) / len(a | b) if a and b else float(a == b))) < 0.25
    edge = fingerprints.edited_fingerprints(awkward).collect()
    assert len(edge) == awkward.count() and all(0 <= r["near_edited"] <= 1 for r in edge)
    assert len({r["fingerprint"] for r in edge if r["doc_id"] in (54, 55)}) == 1
    assert fingerprints.edited_fingerprints(empty).count() == 0
    one = spark.createDataFrame([(1, "a b c d e f")], "doc_id bigint, text string")
    assert fingerprints.edited_fingerprints(one).first()["near_next"] == 1.0
    assert fingerprints.fingerprints(awkward).count() == awkward.count()
    assert {r["doc_id"]: r["class_id"] for r in fingerprints.similar_documents(awkward).collect()}[55] == 54


def test_packing_is_exact_and_dense(spark, awkward, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    rows = best_fit_packing.pack(awkward, capacity=256).collect()
    want = []
    for r in awkward.collect():
        ids = tokenizer.encode(r["text"] or "", add_special_tokens=False).ids + [0]
        for n, start in enumerate(range(0, len(ids), 256)):
            part = np.array(ids[start:start + 256], "<u4")
            want.append((r["doc_id"], n, start, len(part), zlib.crc32(part.tobytes())))
    key = lambda t: tuple((x is not None, x) for x in t)
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows), key=key) == sorted(want, key=key)
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 256
    total = sum(r["length"] for r in rows)
    assert len(by_sequence) <= -(-total // 256) + 2
    assert best_fit_packing.pack(empty).count() == 0


def test_chunked_ids_equal_whole_ids():
    ids = best_fit_packing.Ids(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["á b\x1cc\x85d\u2003e it's IT'S. 'll, x \u0301z İSTANBUL ΟΔΟΣ Σ. <|endoftext|> don't!!.., a.,b. ., x", "", "  ",
             "a\rb\x0bc\x0cd.", "🎉🎉 héllo, wörld. 123 ４５", "ÉTÉ, Ça... ªº µ. ÿ", "word%%% ***x, y!!, z.", "tab\there\nline."]
    for text in texts:
        want = np.array(ids.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        assert ids.encode([text])[0] == want, text


def test_plan_equals_best_fit_decreasing():
    draw = random.Random(4)
    for _ in range(30):
        lengths = [draw.randint(1, 50) for _ in range(draw.randint(0, 200))]
        histogram = {n: lengths.count(n) for n in set(lengths)}
        free = []
        for n in sorted(lengths, reverse=True):
            fits = [f for f in free if f >= n]
            if fits:
                free.remove(min(fits))
                free.append(min(fits) - n)
            else:
                free.append(50 - n)
        rows = best_fit_packing.plan(histogram, 50)
        used = {}
        for length, first, last, sequence, place, each in rows:
            for r in range(first, last):
                used.setdefault(sequence + (r - first) // each, []).append((place + (r - first) % each * length, length))
        assert sum(len(p) for p in used.values()) == len(lengths) and len(used) == len(free)
        for places in used.values():
            at = 0
            for offset, length in sorted(places):
                assert offset == at
                at += length
            assert at <= 50
