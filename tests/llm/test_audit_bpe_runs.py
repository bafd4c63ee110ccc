"""Filter interactions, BPE and periodic runs on odd rows, against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import unicodedata
import zlib
from collections import Counter
from fractions import Fraction
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers
from tokenizers import Tokenizer

from ledgerloom.llm import audit, bpe, runs
from oracle import compare, duck_tables
from test_llm import EN, docs_of, empty, odd, odd_rows  # noqa: F401


def sha(text: bytes | str) -> str:
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


# --- filter interactions ---

def test_audit_equals_sql_and_brute_force(spark, odd):  # noqa: F811
    con = duck_tables(odd)
    for name in ("documents", "labels"):
        con.execute(f"CREATE OR REPLACE VIEW {name} AS SELECT * FROM '{odd}/{name}.parquet/*.parquet'")
    assert compare(spark, con, odd, audit.op11_audit, audit.ORACLES["op11_audit"]) is None
    docs = [tuple(r) for r in spark.read.parquet(f"{odd}/documents.parquet").select(
        "doc_id", "text", "lang").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{odd}/labels.parquet").collect()]
    good = {i for i, q, _ in labels if i is not None and q == 1}
    rows = []
    for i, t, lang in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w),
                 "C": 100 * sum("A" <= ch <= "Z" for ch in t) > 10 * len(t),
                 "D": any(ch in "#$%&*|" for ch in t),
                 "E": i is not None and any(j is not None and j < i and (u or "") == t
                                            for j, u, _ in docs)}
        rows.append((lang or "", i in good, {k for k, v in fails.items() if v}))
    got = {(r["part"], r["filter_order"], r["step"]): r for r in audit.op11_audit(spark, odd).collect()}
    assert len(got) == 600 * len({p for p, _, _ in rows})
    shapley = Counter()
    for part in {p for p, _, _ in rows}:
        here = [(g, f) for p, g, f in rows if p == part]
        for order in permutations("ABCDE"):
            for k, x in enumerate(order):
                r, before = got[part, "".join(order), k + 1], set(order[:k])
                removed = [g for g, f in here if x in f and not f & before]
                assert r["removed"] == len(removed) and r["good_lost"] == sum(removed)
                assert r["kept"] == sum(not f & (before | {x}) for _, f in here)
                assert r["redundant"] == sum(x in f and bool(f & before) for _, f in here)
                assert r["unique_fails"] == sum(f == {x} for _, f in here)
                shapley[part, x] += len(removed)
    assert all(r["shapley"] == shapley[p, o[s - 1]] for (p, o, s), r in got.items())


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5])
def test_swaps_see_every_order(n):
    order = list(range(n))
    seen = [tuple(order)]
    for p in audit.adjacent_swaps(n):
        order[p], order[p + 1] = order[p + 1], order[p]
        seen.append(tuple(order))
    assert sorted(seen) == sorted(permutations(range(n)))


def test_swapped_diagrams_keep_their_counts_and_share_nodes():
    rng = random.Random(2)
    for _ in range(40):
        n = rng.randint(1, 5)
        counts = {m: (rng.choice([0, 1, 5]), rng.randint(0, 3)) for m in range(1 << n)
                  if rng.random() < 0.6} or {0: (1, 1)}
        diagram = audit.Diagram(counts, n)
        for place in [None, *audit.adjacent_swaps(n)]:
            if place is not None:
                diagram.swap(place)
            assert [len(set(x.values())) for x in diagram.levels] == [len(x) for x in diagram.levels]
            for mask in range(1 << n):
                node = diagram.root
                for f in diagram.order:
                    node = (diagram.high if mask >> f & 1 else diagram.low)[node]
                assert diagram.weight[node] == counts.get(mask, (0, 0))


def test_copies_by_key(spark):
    rows = [(5, "a", "x"), (3, "a", "y"), (3, "a", "y"), (9, "a", "x"), (None, "a", "x"),
            (None, "b", "x"), (1, None, None), (2, "", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    flags = spark.createDataFrame([(5, True), (5, None), (3, None), (None, True)], "key long, good boolean")
    got = {(r["part"], r["mask"]): (r["n"], r["good"]) for r in audit.mask_counts(
        audit.failure_masks(docs, tests=()), flags, 0).collect() if r["n"]}
    assert got == {("x", 0): (2, 0), ("y", 0): (2, 0), ("", 0): (1, 0), ("x", 1): (3, 1)}


# --- BPE ---

@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def strange_texts():
    rng = random.Random(3)
    chars = [chr(x) for x in [*range(300), 0x88F, 0x558, 0x10940, 0xD7A3, 0x6771, 0x1F600, 0x3000,
                              0x2028, 0x85, 0x1680]] + ["<|endoftext|>", " ", "'s", "\n"] * 5
    texts = ["".join(rng.choice(chars) for _ in range(rng.randint(0, 200))) for _ in range(300)]
    return texts + ["x" * 100_000, "ab" * 3000 + " " * 500 + "é" * 400, "", " \t\n",
                    "a<|endoftext|><|endoftext|>b <|endoftext|> c"]


def test_bpe_of_odd_rows(spark, odd, library):  # noqa: F811
    want = Counter()
    for i, text in docs_of(spark, odd):
        ids = library.encode(text or "", add_special_tokens=False).ids
        want[i, len(ids), sha(",".join(map(str, ids))),
             sha(library.decode(ids, skip_special_tokens=False))] += 1
    assert Counter(tuple(r) for r in bpe.op12_bpe(spark, odd).collect()) == want


@pytest.mark.parametrize("limit", [0, 40, 5000])
def test_ids_are_the_librarys_whatever_the_lexicon(spark, library, limit):
    texts = strange_texts() + [t for _, t, *_ in odd_rows()]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)],
                                 "doc_id long, text string, ids int")
    rows = bpe.decoded(bpe.encoded(docs, bpe.lexicon(docs, limit=limit))).collect()
    assert len(rows) == len(texts)
    for r in rows:
        t = texts[r["doc_id"]] or ""
        assert r["ids"] == library.encode(t, add_special_tokens=False).ids and r["text"] == t


def test_a_process_keeps_what_one_job_has_left(spark):
    """Lexicons in each Python process after several jobs, none of which leaves its own behind."""
    docs = spark.createDataFrame([(i, f"some words {i}") for i in range(64)],
                                 "doc_id long, text string").repartition(16)
    block = bpe.lexicon(docs)
    for _ in range(4):
        assert bpe.decoded(bpe.encoded(docs, block)).count() == 64

    def held(batches):
        import gc
        import pyarrow as pa

        assert sum(len(b) for b in batches) >= 0
        gc.collect()
        n = sum(type(x).__name__ == "Lexicon" for x in gc.get_objects())
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    counts = [r["n"] for r in docs.select("doc_id").mapInArrow(held, "n long").collect()]
    assert max(counts) == 1


def test_columns_are_cut_as_texts_are():
    tk, rng = bpe.tokenizer(), random.Random(13)
    texts = strange_texts() + ["".join(rng.choice("ab1!' \n\t\x1c\xa0\u3000é") for _ in range(
        rng.randint(0, 30))) for _ in range(500)] + ["a b, c. a", "one", "", " "]
    seen = []
    for where, pieces, codes, ends in tk.cut(pa.array(texts)):
        found = pieces.to_pylist()
        assert len(set(found)) == len(found) and set(codes.tolist()) == set(range(len(found)))
        for i, s, e in zip(where.tolist(), [0, *ends.tolist()], ends.tolist()):
            assert [found[x] for x in codes[s:e]] == tk.pieces(texts[i])
        words, places, stops, order = tk.words_of_pieces(pieces)
        words = words.to_pylist()
        assert len(set(words)) == len(words)
        for i, s, e in zip(order.tolist(), [0, *stops.tolist()], stops.tolist()):
            assert [words[x] for x in places[s:e]] == tk.words(found[i])
        seen += where.tolist()
    assert sorted(seen) == list(range(len(texts)))


@pytest.mark.parametrize("size", [1, 7, 1 << 20])
def test_ids_and_counts_whatever_the_chunks(monkeypatch, library, size):
    monkeypatch.setattr(bpe, "CHUNK", size)
    monkeypatch.setattr(bpe, "BLOCK", size)
    tk, texts = bpe.tokenizer(), [b"a b", None, b"", b"\xff\xfe \xed\xa0\x80", "é  <|endoftext|> b".encode()]
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array([b"out", *texts])],
                                       names=["k", "t"]).slice(1)
    coder = bpe.Encoder(tk, bpe.Lexicon(bpe.compiled([(b" b", [275])])))
    got = {}
    for keys, some in bpe._chunks(iter([batch])):
        for where, ids, ends in coder.encode(some):
            for k, s, e, t in zip(keys.take(pa.array(where)).to_pylist(), [0, *ends], ends,
                                  tk.decode(ids, ends).to_pylist()):
                got[k] = ids[s:e].tolist(), t
    plain = [(t or b"").decode("utf-8", "replace") for t in texts]
    assert library.encode(" b").ids == [275]
    assert got == {k: (library.encode(t, add_special_tokens=False).ids, t)
                   for k, t in enumerate(plain, 1)}


def test_a_task_encodes_and_decodes_in_one_process(spark, odd):  # noqa: F811
    plan = bpe.op12_bpe(spark, odd)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_both_steps_at_once_are_the_two(spark):
    texts = [*strange_texts()[::7], "", None, None]
    docs = spark.createDataFrame([(i % 40 or None, t) for i, t in enumerate(texts)],
                                 "k long, t string")
    block = bpe.lexicon(docs, "t")
    both, two = (Counter((r["k"], tuple(r["ids"]), r["text"]) for r in rows.collect()) for rows in (
        bpe.recoded(docs, block, "k", "t"), bpe.decoded(bpe.encoded(docs, block, "k", "t"), "k")))
    assert both == two and sum(both.values()) == len(texts)


def test_decoding_ids_that_are_no_text(spark, library):
    ids = [[50256, 0, 0], [128, 129, 130, 64], [], None, [99999, 64]]
    rows = spark.createDataFrame(list(enumerate(ids)), "doc_id long, ids array<int>")
    got = {r["doc_id"]: r["text"] for r in bpe.decoded(rows).collect()}
    assert [got[i] for i in range(5)] == [
        library.decode(x or [], skip_special_tokens=False) for x in ids]


def test_the_automaton_is_minimal_and_numbers_words_in_order():
    rng = random.Random(5)
    words = sorted({bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 7))) for _ in range(400)})
    arcs, final = bpe.minimal_automaton(words)
    used, stack = {0}, [0]
    while stack:
        for to in arcs[stack.pop()].values():
            if to not in used:
                used.add(to)
                stack.append(to)
    # States are told apart by what they accept: as many as there are sets of word ends.
    ends = {frozenset(w[len(p):] for w in words if w.startswith(p))
            for p in {w[:i] for w in words for i in range(len(w) + 1)}}
    assert len(used) == len(ends)
    lex = bpe.Lexicon(bpe.compiled([(w, [i, i + 1]) for i, w in enumerate(words)]))
    assert lex.places(words).tolist() == list(range(len(words)))
    assert [np.frombuffer(x, "<i4").tolist() for x in lex.ids_of([0, 7])] == [[0, 1], [7, 8]]
    others = [w + b"z" for w in words] + [b"", b"zz"] + [
        w[:-1] for w in words if w[:-1] not in set(words)]
    assert set(lex.places(others).tolist()) == {-1}
    assert bpe.Lexicon(bpe.compiled([])).places([b"", b"a"]).tolist() == [-1, -1]


def test_both_ways_of_merging_agree():
    tk = bpe.tokenizer()
    rng = random.Random(7)
    words = ["".join(rng.choice("aabeinrst ") for _ in range(rng.randint(0, 32))) for _ in range(500)]
    words += ["<|endoftext|>", "é" * 16, "x" * 33, ""]
    for w, ids in zip(words, tk.merge(words)):
        want = tk._queued([tk.symbol[b] for b in w.encode()])
        assert np.frombuffer(ids, "<i4").tolist() == ([50256] if w == "<|endoftext|>" else want)
    assert tk.merge([]) == []


def test_published_ranks_merge_as_the_merges_do():
    tk = bpe.tokenizer()
    rng = random.Random(11)
    words = ["".join(rng.choice(" aeinorstlé9中.") for _ in range(rng.randint(1, 40))) for _ in range(800)]
    assert tk.merged is not None
    by_ranks = tk.merge(words)
    assert by_ranks == [np.array(tk._queued([tk.symbol[b] for b in w.encode()]), "<i4").tobytes()
                        for w in words]
    assert by_ranks == tk._together([w.encode() for w in words])


def test_the_lexicon_holds_the_most_frequent_words(spark):
    docs = spark.createDataFrame([(i, "aa bb" + " cc" * 5 + " dd" * 3 + " ee" * (i > 0)) for i in range(3)]
                                 + [(9, "x" * 40 + " once")], "doc_id long, text string")
    words = [b"aa", b" bb", b" cc", b" dd", b" ee", b" once", b"x" * 40]
    for limit, held in ((100, 5), (4, 4), (3, 2), (1, 1), (0, 0)):
        places = bpe.Lexicon(bpe.lexicon(docs, limit=limit)).places(words).tolist()
        assert sum(p >= 0 for p in places) == held
        assert not held or places[2] >= 0


def test_words_are_cut_as_the_tokenizer_cuts_every_character():
    """All characters, assigned or not, between letters, digits, signs and spaces."""
    from tokenizers import pre_tokenizers

    own, cutter = bpe.tokenizer(), pre_tokenizers.ByteLevel(add_prefix_space=False)
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000
              and unicodedata.category(chr(c)) not in ("Cn", "Co")]
    points += list(range(0x558, 0x58D)) + [0x88F, 0x10940, 0xE000, 0x10FFFD]
    for at in range(0, len(points), 4000):
        text = "".join(f"a{chr(p)}1{chr(p)}!{chr(p)} {chr(p)} " for p in points[at:at + 4000])
        want = [text[s:e] for _, (s, e) in cutter.pre_tokenize_str(text)]
        assert [w for piece in own.pieces(text) for w in own.words(piece)] == want


def test_pieces_hold_the_words_of_the_text():
    from tokenizers import pre_tokenizers

    own, cutter = bpe.tokenizer(), pre_tokenizers.ByteLevel(add_prefix_space=False)
    rng = random.Random(11)
    for _ in range(2000):
        text = "".join(rng.choice("ab1!' \n\t\x1c\x85\xa0\u3000é東") for _ in range(rng.randint(0, 30)))
        want = [text[s:e] for _, (s, e) in cutter.pre_tokenize_str(text)]
        assert "".join(own.pieces(text)) == text
        assert [w for piece in own.pieces(text) for w in own.words(piece)] == want


# --- periodic runs ---

def slow_runs(words, least=24):
    found = {}
    for q in range(1, len(words) // 3 + 1):
        i = 0
        while i < len(words) - q:
            j = i
            while j < len(words) - q and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(least, 3 * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def periodic_texts(rng, count):
    for _ in range(count):
        size, letters = rng.choice([0, 5, 23, 24, 60, 200, 600]), rng.choice([1, 2, 3, 50])
        t = [rng.randrange(letters) for _ in range(size)]
        for _ in range(rng.randint(0, 4) if size > 9 else 0):
            p, s = rng.randint(1, size // 4), rng.randrange(size)
            block = rng.choice([[rng.randrange(3) for _ in range(p)], [7] * (p - 1) + [8],
                                [1] * (p // 2) + [2] * (p - p // 2),
                                [rng.randrange(40) for _ in range(p)],
                                ([5, 5, 6] * p)[:p]])
            e = min(size, s + rng.randint(3, 6) * p + rng.randint(0, 9))
            t[s:e] = [block[i % p] for i in range(e - s)]
        yield t


@pytest.mark.parametrize("least", [24, 6, 90])
def test_runs_against_brute_force(least):
    rng = random.Random(least)
    n = 0
    for _ in range(60):
        texts = list(periodic_texts(rng, rng.randint(1, 6)))
        got = runs.find_runs([np.array(t, np.int64) for t in texts], least)
        want = [slow_runs(t, least) for t in texts]
        assert got == want
        n += sum(map(len, want))
    assert n > 30


def test_runs_when_hashes_collide(monkeypatch):
    """Hashes of few bits propose too much; what is reported is compared word by word."""
    whole = runs._mixed
    monkeypatch.setattr(runs, "_mixed", lambda x: whole(x) & np.uint64(0x3F))
    rng = random.Random(4)
    for _ in range(20):
        texts = list(periodic_texts(rng, 3))
        assert runs.find_runs([np.array(t, np.int64) for t in texts]) == [slow_runs(t) for t in texts]


def test_runs_of_odd_rows(spark, odd, monkeypatch):  # noqa: F811
    monkeypatch.setattr(runs, "CHUNK", 300)
    want = Counter()
    for i, text in docs_of(spark, odd):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        n, h = len(words), zlib.crc32(str(i).encode())
        if i is not None and h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[x] if x < a else words[a + (x - a) % p] for x in range(n)]
        found = slow_runs(words)
        gone = {x for s, k, q in found for x in range(s + q, s + k)}
        best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2])) if found else (None,) * 3
        want[i, len(found), *best, 1000 * best[1] // best[2] if found else None,
             sha("".join(f"{s},{k},{q}\n" for s, k, q in found)),
             sha(" ".join(w for x, w in enumerate(words) if x not in gone))] += 1
    assert sum(n for (_, k, *_), n in want.items() if k) > 3
    assert Counter(tuple(r) for r in runs.op13_runs(spark, odd).collect()) == want


def test_runs_of_a_long_text(spark):
    words = [f"w{i}" for i in range(9000)]
    text = " ".join(words[:4000] + words[100:3100] * 3 + ["z"] * 40 + words[:50])
    docs = spark.createDataFrame([(1, text, 5), (None, None, 6), (2, "", 7)],
                                 "doc_id long, text string, runs int")
    got = {r["doc_id"]: r for r in runs.periodic_runs(docs).collect()}
    assert [tuple(x) for x in got[1]["runs"]] == [(4000, 9000, 3000), (13000, 40, 1)]
    assert got[1]["collapsed"] == " ".join(words[:4000] + words[100:3100] + ["z"] + words[:50])
    assert got[None]["runs"] == [] and got[None]["collapsed"] == got[2]["collapsed"] == ""
