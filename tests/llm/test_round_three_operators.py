"""Fill-in-the-middle, the n-gram join and spelling variants against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from twotier.llm import fill_in_middle, ngram_join, spelling_variants

from .conftest import EN, FR, plain


def lowered(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


# --- fill in the middle ---

def brute_fim(doc_id, text):
    text, s = text or "", hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(s[i:i + 8], 16) for i in range(0, 32, 8))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    x, y, z = text[:a], text[a:b], text[b:]
    if h4 % 100 < 20:
        return n, "spm", a, b - a, f"<S>{z}<P>{x}<M>{y}"
    return n, "psm", a, b - a, f"<P>{x}<S>{z}<M>{y}"


def mixed_text(n, seed):
    draw = random.Random(seed)
    return "".join(draw.choice(["a", "b ", "é", "日", "🎉", "<", "S>", "\n", "ÿ"]) for _ in range(n))


def test_fill_in_middle_matches_brute_force(spark, awkward, empty):
    rows = [(i, mixed_text(i, i)) for i in range(150)] + [(500 + i, t) for i, t in enumerate(
        ["a<P>b", "<S>", "x<M", "<P", "🎉", "é" * 5000, "a" * 300_000 + "é" + "日" * 1000])]
    for frame in (spark.createDataFrame(rows, "doc_id bigint, text string"), awkward):
        out = fill_in_middle.fill_in_middle(frame)
        got = out.withColumn("back", fill_in_middle.restored(F.col("output"), F.col("form"))).collect()
        want = [(r["doc_id"], *brute_fim(r["doc_id"], r["text"]), r["text"] or "") for r in frame.collect()]
        assert Counter(tuple(r) for r in got) == Counter(want)
    assert {r["form"] for r in got} == {"plain", "spm", "psm"}
    assert fill_in_middle.fill_in_middle(empty).count() == 0


@pytest.mark.parametrize("error", [1, 8, 63])
def test_rank_index_is_exact_and_bounded(error):
    for seed in range(6):
        text = mixed_text(4000, seed) + "a" * 3000 + "日" * 2000 + mixed_text(50, seed)
        data = text.encode()
        offsets = fill_in_middle.boundaries(data)
        index = fill_in_middle.RankIndex(offsets, error)
        ranks = np.arange(len(text) + 1)
        assert index.offsets(ranks).tolist() == [0, *np.cumsum([len(c.encode()) for c in text]).tolist()]
        assert np.abs(index.predicted(ranks) - offsets).max() <= error + 1
        assert 1 < len(index.first) < len(text)
    assert len(fill_in_middle.RankIndex(fill_in_middle.boundaries(b"plain ascii " * 1000)).first) == 1
    assert fill_in_middle.RankIndex(fill_in_middle.boundaries(b"")).offsets(np.array([0])).tolist() == [0]


def test_rank_index_steps_do_not_matter(monkeypatch):
    offsets = fill_in_middle.boundaries((mixed_text(5000, 3) + "x" * 5000).encode())
    one = fill_in_middle.RankIndex(offsets)
    monkeypatch.setattr(fill_in_middle, "FIRST_STEP", 3)
    monkeypatch.setattr(fill_in_middle, "LAST_STEP", 17)
    other = fill_in_middle.RankIndex(offsets)
    assert one.first.tolist() == other.first.tolist() and (one.residuals == other.residuals).all()


# --- n-gram join ---

def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", lowered(text))
    return frozenset(tuple(w[i:i + 4]) for i in range(max(1, len(w) - 3))) if w else frozenset()


def brute_components(rows):
    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    parent = {i: i for i, _ in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if a and b and 100 * len(a & b) >= 85 * len(a | b):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return {i: root(i) for i, _ in sets}


def edited(words, n, edits, seed):
    draw = random.Random(seed)
    out = []
    for _ in range(n):
        w = list(words)
        for _ in range(draw.randint(0, edits)):
            w[draw.randrange(len(w))] = f"w{draw.randint(0, 10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("block, columns", [(ngram_join.BLOCK, ngram_join.COLUMNS), (8, 50)])
def test_ngram_join_matches_brute_force(spark, monkeypatch, block, columns):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "COLUMNS", columns)
    line = plain(EN, 30, 77)
    texts = [t for words, n, edits, seed in ((150, 90, 6, 1), (60, 40, 2, 2), (30, 40, 2, 3), (400, 30, 14, 4))
             for t in edited(plain(EN + FR, words, seed).split(), n, edits, seed)]
    texts += [plain(EN, 50, s) for s in range(20)] + [f"{plain(FR, 60, s)} {line} {plain(EN, 40, s)}" for s in range(40)]
    random.Random(5).shuffle(texts)
    rows = [(i + 10, t) for i, t in enumerate(texts)]
    found = ngram_join.linked_sets(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)).collect()
    want = brute_components(rows)
    assert {r["doc_id"]: r["component_id"] for r in found} == want
    assert len(set(want.values())) > 80
    assert all(r["n_shingles"] == len(shingles(dict(rows)[r["doc_id"]])) for r in found)


def test_ngram_join_edges(spark, awkward, empty):
    found = ngram_join.linked_sets(awkward).collect()
    assert len(found) == awkward.count()
    by_id = {r["doc_id"]: r for r in found if r["doc_id"] is not None}
    assert {i: r["component_id"] for i, r in by_id.items()} == brute_components([(r["doc_id"], r["text"]) for r in awkward.collect()])
    assert by_id[50]["n_shingles"] == 0 and by_id[57]["n_shingles"] == 1 and by_id[58]["component_id"] == 57
    assert all(r["component_id"] is None for r in found if r["doc_id"] is None)
    assert ngram_join.linked_sets(empty).count() == 0


def test_one_id_with_two_texts_joins_both_sets(spark):
    a, b = plain(EN, 40, 1), plain(FR, 40, 2)
    rows = [(1, a), (2, b), (3, a), (3, b), (4, b + " x")]
    found = ngram_join.linked_sets(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == {1: 1, 2: 1, 3: 1, 4: 1}


def test_entries_are_shuffled_once(spark, capsys):
    rows = [(1, 10), (1, 10), (1, 11), (2, 10), (2, 10), (3, 12), (4, 10), (4, 11), (4, 12), (4, 12)]
    matrix = spark.createDataFrame(rows, "col bigint, k1 bigint").repartition(3)
    found = ngram_join.shared_entries(matrix)
    assert sorted(map(tuple, found.collect())) == [(1, 10), (1, 11), (4, 10), (4, 11), (4, 12)]
    capsys.readouterr()
    ngram_join.shared_entries(spark.range(100).selectExpr("id % 7 as col", "id as k1")).explain()
    plan = capsys.readouterr().out
    assert plan.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" not in plan and "HashAggregate" in plan


def test_rows_of_unrepeated_ids_are_not_shuffled(spark, monkeypatch):
    shown = []
    kept = ngram_join.kept

    def noted(df, name):
        out = kept(df, name)
        if name == "rows":
            shown.append(out.count())
        return out

    monkeypatch.setattr(ngram_join, "kept", noted)
    docs = [(1, "a b c d e"), (2, "a b c d f"), (3, "x y z w v"), (3, "x y z w v"), (3, "x y z w u"), (3, ""), (4, "q r s t")]
    docs = spark.createDataFrame(docs, "doc_id bigint, text string")
    sizes = ngram_join.scan(docs).where("part is null").select("doc_id", "n", "k1", "k2")
    rows = ngram_join._rows(docs, spark.createDataFrame([(1,), (2,), (3,)], "cid bigint"), sizes).collect()
    assert sorted(r["cid"] for r in rows) == [1, 2, 3, 3] and shown == [5, 2]
    assert all(len(r["row"]) == 16 for r in rows)


def test_one_id_with_a_text_and_an_empty_one(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 8)  # columns of more rows go to representatives
    texts = edited(plain(EN, 150, 9).split(), 30, 2, 9)
    rows = [(1, ""), (1, texts[0])] + [(i + 1, t) for i, t in enumerate(texts) if i] + [(40, "")]
    found = ngram_join.linked_sets(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    want = brute_components([r for r in rows if r[1]]) | {40: 40}
    assert {r["doc_id"]: r["component_id"] for r in found} == want and len(found) == len(rows)


def test_block_product_counts_exactly():
    draw = np.random.default_rng(4)
    base = draw.integers(0, 2**63, 300, dtype=np.uint64)
    rows = [np.unique(np.concatenate([base[draw.random(300) < 0.97], draw.integers(0, 2**63, draw.integers(0, 20), dtype=np.uint64)]))
            for _ in range(40)]
    left, right = rows[:15], rows[10:]
    wanted = draw.random((15, 30)) < 0.8
    got = ngram_join.overlaps(left, right, wanted, 85)
    for i, a in enumerate(left):
        for j, b in enumerate(right):
            both = len(np.intersect1d(a, b))
            assert got[i, j] == (wanted[i, j] and 100 * both >= 85 * (len(a) + len(b) - both))
    assert 0 < got.sum() < wanted.sum()


def test_spanning_links_connect_as_much():
    draw = np.random.default_rng(7)
    for share in (0.01, 0.05, 0.5):
        links = draw.random((30, 40)) < share
        few = ngram_join.spanning(links)
        assert len(few) < 70 and all(links[i, j] for i, j in few)

        def roots(pairs):
            parent = list(range(70))

            def root(i):
                while parent[i] != i:
                    i = parent[i]
                return i
            for i, j in pairs:
                x, y = sorted((root(int(i)), root(30 + int(j))))
                parent[y] = x
            return [root(i) for i in range(70)]
        assert roots(few) == roots(zip(*np.nonzero(links)))


# --- spelling variants ---

def brute_variants(rows):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lowered(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))

    out = {}
    for w, n in words.items():
        close = [(-words[x], x) for x in words if abs(len(x) - len(w)) <= 1 and near(w, x)]
        m, form = min(close, default=(0, None))
        out[w] = (form, n, len(close), -m) if form and -m >= 2 * n else (None, n, len(close), None)
    rooted = {}
    for w in out:
        root = w
        while out[root][0]:
            root = out[root][0]
        rooted[w] = (w, out[w][0], root, *out[w][1:])
    return rooted


def spelled_rows():
    draw = random.Random(8)
    stems = ["".join(draw.choice("abcdeéÿàmn") for _ in range(draw.randint(5, 9))) for _ in range(60)] + ["aaaaaa", "aaaaa", "b" * 70, "b" * 71]
    rows = []
    for i in range(120):
        words = []
        for _ in range(60):
            w = draw.choice(stems[:draw.randint(1, len(stems))])
            if draw.random() < 0.3:
                at = draw.randrange(len(w))
                w = draw.choice([w[:at] + w[at + 1:], w[:at] + draw.choice("aeéz") + w[at:], w[:at] + draw.choice("aeéz") + w[at + 1:]])
            words.append(w.upper() if draw.random() < 0.1 and w.isascii() else w)
        rows.append((i, draw.choice([" ", "-", "3"]).join(words)))
    rows += [(300, "chainab " * 20 + "chainac " * 8 + "chaimac " * 3)]  # a chain of two forms
    return rows + [(None, "Aaaaaa " * 4), (200, None), (200, ""), (201, "日本aaaaa語 🎉bbbbbé " * 3), (201, "aaaaab " * 3)]


@pytest.mark.parametrize("pass_bytes", [spelling_variants.PASS_BYTES, 1])
def test_spelling_variants_match_brute_force(spark, monkeypatch, pass_bytes):
    if pass_bytes == 1:  # small segments, one a pass, and small chunks
        monkeypatch.setattr(spelling_variants, "SEGMENT", 2)
        monkeypatch.setattr(spelling_variants, "CHUNK", 100)
        monkeypatch.setattr(spelling_variants, "FLUSH", 50)
    rows = spelled_rows()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    if pass_bytes == 1:
        rows = rows[:25]
        docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = brute_variants(rows)
    got = spelling_variants.spelling_variants(docs, pass_bytes).collect()
    assert {r["word"]: tuple(r) for r in got} == want and len(got) == len(want)
    assert any(r["root"] not in (r["form"], r["word"]) for r in got) or pass_bytes == 1


def test_spelling_variant_edges(spark, awkward, empty):
    want = brute_variants([(r["doc_id"], r["text"]) for r in awkward.collect()])
    got = spelling_variants.spelling_variants(awkward).collect()
    assert {r["word"]: tuple(r) for r in got} == want and want
    assert spelling_variants.spelling_variants(empty).count() == 0


def test_edits_and_filters_lose_nothing():
    words = ["abcde", "aabbé", "zzzzzz", "ÿÿàéa", "b" * 60]
    spelled = spelling_variants.Spelled([w.encode("latin-1") for w in words])
    hashes = spelled.words()
    found = {}
    for who, edit, lengths in spelled.edits():
        for i, h, n in zip(who.tolist(), edit.tolist(), lengths.tolist()):
            found.setdefault(i, []).append((h, n))
    letters = spelling_variants.LETTERS.tobytes().decode("latin-1")
    for i, w in enumerate(words):
        edits = {w[:k] + w[k + 1:] for k in range(len(w))} | {w[:k] + c + w[k + 1:] for k in range(len(w)) for c in letters if c < w[k]}
        own = spelling_variants.Spelled([e.encode("latin-1") for e in edits]).words().tolist()
        assert sorted(found[i]) == sorted(zip(own, [len(e) for e in edits]))
    draw = np.random.default_rng(2)
    bits = np.zeros(64 * 512, bool)
    known = draw.integers(0, 2**63, 2000, dtype=np.uint64)
    block = ((known >> np.uint64(32)) * np.uint64(64)) >> np.uint64(32)
    for j in range(spelling_variants.PROBES):
        bits[(block * np.uint64(512) + ((spelling_variants.probe_bits(known) >> np.uint64(9 * j)) & np.uint64(511))).astype(np.int64)] = True
    held = spelling_variants.Filters({5: 64}, {5: (0, 64, 0)}, np.packbits(bits, bitorder="little").view(np.uint64))
    assert len(held.passes(known, np.full(2000, 5))) == 2000
    other = draw.integers(0, 2**63, 100_000, dtype=np.uint64)
    assert len(held.passes(other, np.full(100_000, 5))) < 1000
    assert len(held.passes(known, np.full(2000, 6))) == 0
    assert hashes.dtype == np.uint64


def test_filters_of_hashes_over_all_bits_pass_few_others():
    draw = np.random.default_rng(2)
    bits = np.zeros(64 * 512, bool)
    known, other = (draw.integers(0, 2**64, n, dtype=np.uint64) for n in (2000, 100_000))
    block = ((known >> np.uint64(32)) * np.uint64(64)) >> np.uint64(32)
    for j in range(spelling_variants.PROBES):
        bits[(block * np.uint64(512) + ((spelling_variants.probe_bits(known) >> np.uint64(9 * j)) & np.uint64(511))).astype(np.int64)] = True
    held = spelling_variants.Filters({5: 64}, {5: (0, 64, 0)}, np.packbits(bits, bitorder="little").view(np.uint64))
    assert len(held.passes(known, np.full(2000, 5))) == 2000
    assert len(held.passes(other, np.full(100_000, 5))) < 1000
