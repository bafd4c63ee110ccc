"""The training-data operators on a small table of odd rows, against brute force."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from ledgerloom.llm import (
    common, embeddings, language, licenses, lines, mixing, packing, pii, queries, quality,
    simhash, spotsigs,
)
from oracle import compare, duck_tables

EN = "the king of the hill was there and he saw that it is good to be in the house of a friend "
FR = "le roi est dans la maison avec une femme et il ne veut pas que les enfants soient sur la rue "
COLUMNS = ("doc_id long, text string, lang string, source string, n_chars long, "
           "score double, row string, size string, fp string, taken string, lang_pred string")


def odd_rows() -> list[tuple]:
    """Nulls in any column, empty and long texts, ties, repeated rows, clashing names."""
    texts = [
        None, "", " \t\n", "...!!", "one", "two words", EN, FR, EN * 3, FR * 3, EN, EN + FR,
        EN * 3 + "x", "mail joe@example.org or 10.1.2.3\nThis file is under the MIT License.\n"
        "MIT license and Apache License; the GNU General Public License",
        "card 4111 1111 1111 1111 phone +1 (555) 010-2030\n" + EN, "é" * 70 + " 東京 " + "a" * 9000,
        (EN + "\n") * 400, "x" * 100_000, "+1+2 1.2.3.4.5.6 999.1.1.1 a@b@c.d.e 1-1 - 2",
        "\x1c a\x1c b  c \n d e <|endoftext|> 's'S",
    ]
    rows = []
    for i, t in enumerate(texts * 2):
        rows.append((i, t, None, (None, "a", "b", "")[i % 4],
                     len(t or ""), 0.5, "r", "s", "f", "t", "p"))
    rows += [rows[8], rows[8], (None, EN * 2, "en", "a", 1, None, None, None, None, None, None),
             (None, None, None, None, None, None, None, None, None, None, None)]
    for i in range(60):
        body = (EN if i % 2 else FR).split()
        words = np.random.default_rng(i).choice(body, 40).tolist()
        rows.append((100 + i, " ".join(words), "en" if i % 2 else "fr", "ab"[i % 2], 1, 0.0,
                     "r", "s", "f", "t", "p"))
    return rows


def save(spark, folder, rows, empty=False):
    docs = spark.createDataFrame([] if empty else rows, COLUMNS)
    docs.repartition(3).write.parquet(f"{folder}/documents.parquet")
    labels = [] if empty else [(100 + i, i % 2, 0) for i in range(60)] + [
        (None, 1, 0), (3, None, None), (100, 1, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(
        f"{folder}/labels.parquet")
    rng = np.random.default_rng(5)
    vectors = [rng.normal(size=16) for _ in range(40)]
    vectors += [v + 0.12 * rng.normal(size=16) for v in vectors[:20]] + vectors[:5]
    table = [(i, [float(x) for x in v], 0, 1) for i, v in enumerate(vectors)] + [
        (200, None, 0, 1), (201, [0.0] * 16, 0, 1), (202, [float("nan")] * 16, 0, 1),
        (203, [], 0, 1), (204, [1.0] * 15 + [None], 0, 1), (205, [1e300] * 16, None, 1),
        (206, [1e-300] * 16, 0, 1), (207, [float("inf")] * 16, 0, 1), (208, [1.0], 0, 1),
        (209, [-1.0], 0, 1), (None, [1.0] * 16, 0, 1), (3, [float(x) for x in vectors[3]], 0, 1)]
    spark.createDataFrame([] if empty else table,
                          "vec_id long, embedding array<double>, label int, size int"
                          ).write.parquet(f"{folder}/embeddings.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    return save(spark, tmp_path_factory.mktemp("odd"), odd_rows())


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return save(spark, tmp_path_factory.mktemp("empty"), [], empty=True)


def docs_of(spark, sf):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]


def roots(keys, linked):
    """Smallest key reachable, by brute force."""
    label = {k: k for k in keys}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return label


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty_tables_give_no_rows(spark, empty, name):
    assert queries.QUERIES[name](spark, empty).count() == 0


@pytest.mark.parametrize("name", sorted(
    set(queries.QUERIES) - {"op2_packing", "op4_embeddings", "op11_audit"}))
def test_one_row_for_each_document(spark, odd, name):
    got = Counter(r["doc_id"] for r in queries.QUERIES[name](spark, odd).collect())
    assert got == Counter(i for i, _ in docs_of(spark, odd))


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(50)] + [(1000, 1000 + i) for i in range(1, 60)] + [(7, 7)]
    got = common.components(spark.createDataFrame(edges, "a long, b long")).collect()
    want = roots({x for e in edges for x in e}, edges)
    assert {r["node"]: r["root"] for r in got} == want and len(got) == len(want)


# --- languages ---

def test_languages(spark, odd):
    got = {r["doc_id"]: r for r in language.op10_language(spark, odd).collect()}
    for i, text in docs_of(spark, odd):
        if i is None:
            continue
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)
        has_letter = any(ch.isalpha() for ch in text or "")
        assert (got[i]["lang_pred"] == "und") == (not has_letter)
        assert 0 <= got[i]["score"] <= 1
    assert (got[6]["lang_pred"], got[7]["lang_pred"]) == ("en", "fr")
    assert set(got[11]["languages"]) == {"en", "fr"}


def test_held_out_languages(spark):
    sf = "/root/testdata/sf0.01"
    true = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = [r for r in language.op10_language(spark, sf).collect() if r["held_out"]]
    assert sum(r["lang_pred"] == true[r["doc_id"]] for r in got) > 0.97 * len(got)


def test_mixture_splits_words_of_two_languages():
    texts = [EN * 3, FR * 3, EN + FR + FR, "", None]
    grams = [np.bincount(language.word_trigrams([t])[0], minlength=language.BUCKETS) + 0.5
             for t in (EN, FR)]
    logp = np.log(np.stack([g / g.sum() for g in grams], axis=1)).astype(np.float32)
    pi, words = language.mixture(texts, logp)
    assert pi[0].tolist() == [1, 0] and pi[1].tolist() == [0, 1]
    assert 0.2 < pi[2, 0] < 0.5 and words.tolist()[3:] == [0, 0]


# --- SimHash ---

def slow_fingerprint(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    shingles = [" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_against_brute_force(spark, odd):
    rows = docs_of(spark, odd)
    fps = {i: slow_fingerprint(t) for i, t in rows if i is not None}
    linked = [(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= 3]
    want = roots(fps, linked)
    for r in simhash.op6_simhash(spark, odd).collect():
        if r["doc_id"] is not None:
            assert r["fingerprint"] == f"{fps[r['doc_id']]:016x}"
            assert r["component_id"] == want[r["doc_id"]]


@pytest.mark.parametrize("run,levels", [(2048, 3), (8, 2), (4, 0)])
def test_links_in_dense_keys(spark, run, levels, monkeypatch):
    """A Hamming ball and random points; small runs force keys to be split again."""
    monkeypatch.setattr(simhash, "RUN", run)
    rng = np.random.default_rng(3)
    base = int(rng.integers(0, 1 << 62))
    fps = {base ^ sum(1 << int(b) for b in rng.choice(12, rng.integers(0, 6), False))
           for _ in range(150)} | {int(x) for x in rng.integers(0, 1 << 62, 150)}
    ids = {f: i for i, f in enumerate(sorted(fps))}
    nodes = spark.createDataFrame([(f, i) for f, i in ids.items()], "fp long, id long")
    edges = [(r["a"], r["b"]) for r in simhash.link(nodes, 3, run, levels).collect()]
    by = {i: f for f, i in ids.items()}
    true = [(a, b) for a in by for b in by if a < b and (by[a] ^ by[b]).bit_count() <= 3]
    assert roots(by, edges) == roots(by, true)


@pytest.mark.parametrize("parts", simhash.PARTS)
def test_allocation_sums_and_is_cheapest(parts):
    rng = np.random.default_rng(parts)
    total = 3 - parts + 1
    cost = rng.random((parts, total + parts + 1)).cumsum(1)
    got = simhash.allocate(cost, total)
    options = np.indices((total + parts + 1,) * parts).reshape(parts, -1).T - 1
    best = min(sum(cost[i, t + 1] for i, t in enumerate(o)) for o in options if sum(o) == total)
    assert sum(got) == total
    assert np.isclose(sum(cost[i, t + 1] for i, t in enumerate(got)), best)


def test_the_stage_keeps_one_of_each_group(spark):
    """Words changed in copies; groups by the operator's shingle length and distance."""
    rng = np.random.default_rng(12)
    texts = []
    for _ in range(12):
        words = [f"w{x}" for x in rng.integers(0, 3000, 400)]
        texts.append(" ".join(words))
        for changes in (0, 1, 2, 40):
            new = list(words)
            for at in rng.choice(400, changes, False):
                new[at] = "changed"
            texts.append(" ".join(new))
    fps = [slow_fingerprint(t) for t in texts]
    pairs = [(a, b) for b in range(len(texts)) for a in range(b)
             if (fps[a] ^ fps[b]).bit_count() <= 3]
    want = roots(range(len(texts)), pairs)
    rows = list(enumerate(texts)) + [(0, texts[0]), (None, texts[5]), (None, "alone"), (None, "alone")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = simhash.keep_one(spark, docs, "").collect()
    assert sorted(r["doc_id"] for r in kept if r["doc_id"] is not None) == sorted(set(want.values()))
    assert {r["text"] for r in kept if r["doc_id"] is None} == {"alone"}


# --- personal data ---

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
            "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def slow_spans(text):
    out = []
    for kind, p in PATTERNS.items():
        for m in re.finditer(p, text):
            digits = re.sub(r"\D", "", m[0])
            if ((kind == "ip" and max(map(int, m[0].split("."))) > 255)
                    or (kind == "card" and not (16 <= len(digits) <= 19 and pii.luhn(digits)))
                    or (kind == "phone" and not 8 <= len(digits) <= 15)):
                continue
            out.append((kind, *m.span()))
    return out


def test_base_spans_against_the_patterns():
    rng = np.random.default_rng(2)
    for alphabet in ("a1.@-+ ()5%", "12.5 -+", "a@.b", "4 -1"):
        for _ in range(400):
            text = "".join(rng.choice(list(alphabet), 70))
            assert pii.base_spans(text) == slow_spans(text), text


def test_personal_data_of_odd_rows(spark, odd):
    texts = dict(docs_of(spark, odd))
    for r in pii.op9_pii(spark, odd).collect():
        if r["doc_id"] is None:
            continue
        base = slow_spans(texts[r["doc_id"]] or "")
        spelled = ",".join(f"{k}:{s}:{e}" for k, s, e in base)
        assert r["base_sha256"] == hashlib.sha256(spelled.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(x[0] == k for x in base) for k in pii.KINDS]
        assert {x for x in spelled.split(",") if x} <= set(r["spans"].split(","))


def test_field_learns_its_table_and_adds_spans():
    model = pii.train()
    for row in pii.labelled_tokens(pii.LABELLED):
        found = pii.found_by_field([" ".join(t for t, _ in row)], model)[0]
        assert {k for k, _, _ in found} == {label for _, label in row} - {"O"}
    text = "call me on 555-010-2030 before 10:30, order 123456"
    base, spans = pii.all_spans([text], model)[0]
    assert not base and [text[s:e] for _, s, e in spans] == ["555-010-2030"]
    assert pii.mask(text, spans) == "call me on [PHONE] before 10:30, order 123456"


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(1)
    emit, t = rng.normal(size=(1, 4, 3)), rng.normal(size=(3, 3))
    paths = np.indices((3,) * 4).reshape(4, -1).T
    score = [t[0, p[0]] + sum(emit[0, j, p[j]] for j in range(4))
             + sum(t[p[j], p[j + 1]] for j in range(3)) + t[p[-1], 0] for p in paths]
    assert pii.viterbi(emit, t)[0].tolist() == paths[int(np.argmax(score))].tolist()


# --- mixing ---

def test_mixing_equals_sql(spark, odd):
    con = duck_tables(odd)
    for name in ("documents", "labels"):
        con.execute(f"CREATE OR REPLACE VIEW {name} AS SELECT * FROM '{odd}/{name}.parquet/*.parquet'")
    assert compare(spark, con, odd, mixing.op1_mixing, mixing.ORACLES["op1_mixing"]) is None


def test_targets_by_repeated_resharing(spark):
    sizes = [("a", 10), ("b", 1000), ("c", 500), ("d", 0), ("e", 3), ("f", 900), (None, 70)]
    got = {r["source"]: r["target"] for r in mixing.targets(
        spark.createDataFrame(sizes, "source string, source_size long")).collect()}
    weight = {s: (5.0, 2.0, 1.0)[i % 3] for i, (s, _) in enumerate(sizes)}
    left, target, free = 1.5 * sum(n for _, n in sizes), {}, dict(sizes)
    while True:
        level = left / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] > 2 * free[s]]
        if not over:
            break
        for s in over:
            target[s] = 2.0 * free.pop(s)
            left -= target[s]
    target |= {s: level * weight[s] for s in free}
    assert got == pytest.approx(target)


def test_the_stage_takes_the_words_of_the_mix(spark, tmp_path):
    """Rows that share a doc_id, repeat each other or have none are each taken as planned."""
    rng = np.random.default_rng(3)
    rows = [(None if i % 3 else 7 if i % 2 else i, " ".join(["w"] * int(rng.integers(0, 12))),
             "ab"[i % 5 == 0], f"x{i}") for i in range(90)] + [(7, "w w", "a", "same")] * 3
    rows += [(500, None, "a", None), (501, "", None, None), (502, "w", None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, source string, copies string"
                          ).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, 1)], "doc_id long, quality int").write.parquet(
        f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    plan = mixing.op1_mixing(spark, str(tmp_path)).collect()
    got = mixing.mixed(spark, docs, str(tmp_path))
    assert got.columns == docs.columns
    words = lambda t: len((t or "").split())
    assert sum(words(r["text"]) for r in got.collect()) == sum(r["taken"] for r in plan)
    want = Counter()
    for r in plan:
        want[r["doc_id"]] += r["taken"]
    have = Counter()
    for r in got.collect():
        have[r["doc_id"]] += words(r["text"])
    assert have == Counter({k: v for k, v in want.items() if v})


# --- packing ---

def test_packed_sequences_are_whole_and_gapless(spark, odd):
    import public_tokenizers
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for i, text in docs_of(spark, odd):
        ids = tk.encode(text or "", add_special_tokens=False).ids + [0]
        n, first = len(ids), len(ids) % 2048 or 2048
        cuts = [0] if n <= 2048 else [0, *range(first, n, 2048)]
        for piece, (s, e) in enumerate(zip(cuts, [*cuts[1:], n])):
            crc = zlib.crc32(np.array(ids[s:e], "<u4").tobytes())
            want[(i, piece, s, e - s, crc)] += 1
    rows = packing.op2_packing(spark, odd).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"])
                   for r in rows) == want
    assert_gapless([(r["sequence_id"], r["offset"], r["length"]) for r in rows], 2048)


def test_ids_are_those_of_the_tokenizer_as_loaded():
    import public_tokenizers
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [t or "" for _, t, *_ in odd_rows()]
    texts += ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|> x", "a\n<|endoftext|>",
              "<|ENDOFTEXT|> <|endoftext |>", "<|endoftext<|endoftext|>|>", "a  <|endoftext|>  b"]
    for t in texts:
        got = np.frombuffer(packing.tokens().encode(t), "<u4").tolist()
        assert got == tk.encode(t, add_special_tokens=False).ids, t[:80]
    assert 50256 in tk.encode(texts[-1], add_special_tokens=False).ids


def assert_gapless(rows, capacity):
    at = {}
    for seq, offset, length in sorted(rows):
        assert at.get(seq, 0) == offset
        at[seq] = offset + length
    assert max(at.values()) <= capacity
    return len(at)


@pytest.mark.parametrize("per_range", [200_000, 60])
def test_packing_is_near_the_bound(spark, per_range):
    rng = np.random.default_rng(4)
    sizes = np.concatenate([rng.integers(1, 101, 400), np.full(50, 100), np.full(60, 7)]).tolist()
    items = spark.createDataFrame([(i, int(s)) for i, s in enumerate(sizes)], "id long, size long")
    rows = packing.pack(items, 100, per_range).collect()
    assert sorted(r["id"] for r in rows) == list(range(len(sizes)))
    n = assert_gapless([(r["bin"], r["offset"], sizes[r["id"]]) for r in rows], 100)
    assert n <= 1.06 * -(-sum(sizes) // 100) + 2


def test_sequences_hold_the_documents_ids(spark):
    docs = spark.createDataFrame([(i, EN * (i + 1)) for i in range(6)], "doc_id long, text string")
    place = packing.packed(docs, capacity=64)
    rows = packing.sequences(docs, place, capacity=64).collect()
    whole = packing.tokenized_pieces(docs, capacity=64, with_ids=True).collect()
    assert sorted(x for r in rows for x in r["ids"]) == sorted(x for r in whole for x in r["ids"])
    assert all(len(r["ids"]) <= 64 for r in rows)


# --- lines ---

def test_lines_keep_the_earliest(spark, odd):
    rows = sorted((r for r in docs_of(spark, odd) if r[0] is not None and r[0] != 8),
                  key=lambda r: r[0])
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in lines.without_repeats(docs).collect()}
    seen = set()
    for i, text in rows:
        if text is None:
            assert got[i]["text"] is None
            continue
        kept, removed, at = [], [], 0
        for line in text.split("\n"):
            words = " ".join(re.findall(r"\w+", line.lower()))
            if len(words.split()) >= 5 and words in seen:
                removed.append((at, at + len(line)))
            else:
                kept.append(line)
            if len(words.split()) >= 5:
                seen.add(words)
            at += len(line) + 1
        assert got[i]["text"] == "\n".join(kept)
        assert [tuple(x) for x in got[i]["removed"]] == removed


def slow_passages(rows):
    """Texts without repeated stretches, by the parameters of the query."""
    seen, out = set(), {}
    for i, text in rows:
        if text is None:
            out[i] = (None, "")
            continue
        spans, at = [], 0
        for m in re.finditer(lines.SENTENCE, text):
            spans.append((at, m.start(), m.end()))
            at = m.end()
        spans.append((at, len(text), len(text)))
        hashed = []
        for s, e, cut in spans:
            words = re.findall(r"\w+", text[s:e].lower()) or text[s:e].split()
            if words:
                hashed.append((s, e, cut, words, " ".join(words) in seen))
                seen.add(" ".join(words))
        gone, stretch = [], []
        for h in [*hashed, (0, 0, 0, [], False)]:
            if h[4]:
                stretch.append(h)
            else:
                if sum(len(x[3]) for x in stretch) >= 25:
                    gone += stretch
                stretch = []
        kept, at = "", 0
        for s, e, cut, _, _ in gone:
            kept, at = kept + text[at:s], cut
        rest = text[at:]
        if gone and not rest and gone[-1][1] == len(text) and kept:
            kept = re.sub(r"(\n|(?<=[.!?])[ \t]+)$", "", kept, count=1) if gone[-1][2] == len(text) else kept
        out[i] = (kept + rest, ",".join(f"{s}:{e}" for s, e, *_ in gone))
    return out


def test_the_query_removes_repeated_passages(spark, tmp_path):
    """The query's own parameters: short units count, single short repeats stay, null keys rank
    last and repeated rows lose all but the first."""
    rng = np.random.default_rng(21)
    say = lambda n: " ".join(f"v{x}" for x in rng.integers(0, 90, n))
    passage = ". ".join([say(11), "Yes", say(9), say(14) + "\n" + say(8), say(12)]) + "."
    rows = [(1, f"{say(9)}.\nYes.\n{passage} {say(5)}."), (2, f"{say(7)}. {passage}\n{say(4)}"),
            (3, f"{say(20)}. Yes. {say(3)}"), (4, passage.upper()), (5, None), (6, ""),
            (7, f"{say(8)} mid {passage[20:-20]} {say(6)}. End"), (8, "\n\n***\n东京的夜景。" * 3),
            (9, f"{say(30)}.\n\n{say(9)}"), (20, f"x. {passage}")]
    rows.append((9, rows[8][1]))
    docs = [*rows, (None, passage)]
    spark.createDataFrame(docs, "doc_id long, text string").coalesce(1).write.parquet(
        f"{tmp_path}/documents.parquet")
    want = slow_passages([(j, t) for j, (_, t) in enumerate(sorted(
        docs, key=lambda r: (r[0] is None, r[0] or 0)))])
    keys = sorted((k for k, _ in docs), key=lambda k: (k is None, k or 0))
    got = Counter((r["doc_id"], r["text"], r["removed"]) for r in lines.op3_lines(
        spark, str(tmp_path)).collect())
    assert got == Counter((k, *want[j]) for j, k in enumerate(keys))
    texts = {k: t for k, t, _ in got}
    assert texts[3] == rows[2][1] and texts[4] == "" and texts[20] == "x."
    assert passage[40:80] in texts[1] and passage[40:80] not in texts[7] and texts[None] == ""


def test_paragraphs(spark):
    p = "one two three four five six"
    docs = spark.createDataFrame([(1, f"{p}\n\nother"), (2, f"x\n\n{p}"), (3, p)],
                                 "doc_id long, text string")
    got = lines.without_repeats(docs, separator=lines.PARAGRAPH).collect()
    assert {r["doc_id"]: r["text"] for r in got} == {1: f"{p}\n\nother", 2: "x", 3: ""}


# --- embeddings ---

@pytest.mark.parametrize("block", [1024, 7])
def test_embeddings_against_brute_force(spark, odd, block):
    table = spark.read.parquet(f"{odd}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in table.collect()]
    good = [(i, np.array(v)) for i, v in rows
            if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    unit = [(i, v / np.abs(v).max()) for i, v in good]
    unit = [(i, v / np.linalg.norm(v)) for i, v in unit]
    links, edges = [Counter() for _ in good], []
    for x, (i, a) in enumerate(unit):
        for y, (j, b) in enumerate(unit):
            if x != y and len(a) == len(b) and a @ b >= 0.95:
                links[x][y] += 1
                edges.append((i, j))
    ids = {i for i, _ in rows if i is not None}
    want = roots(ids, edges)
    n = {i: sum(c.values()) for (i, _), c in zip(good, links)}
    for r in embeddings.near_duplicates(table, block=block).collect():
        if r["vec_id"] is None:
            assert (r["n_links"], r["component_id"], r["kept"]) == (0, None, False)
            continue
        assert r["component_id"] == want[r["vec_id"]]
        assert r["n_links"] == n.get(r["vec_id"], 0)
        assert r["kept"] == (r["vec_id"] == r["component_id"])


def test_visits_are_in_order_of_distance():
    rng = np.random.default_rng(9)
    x, books = rng.normal(size=(20, 8)), (rng.normal(size=(5, 4)), rng.normal(size=(6, 4)))
    grid = (embeddings.distances(x[:, :4], books[0])[:, :, None]
            + embeddings.distances(x[:, 4:], books[1])[:, None, :]).reshape(20, -1)
    for n in (1, 4, 30):
        assert (embeddings.visited(x, books, n) == np.argsort(grid, 1, kind="stable")[:, :n]).all()


# --- quality ---

def test_held_out_quality(spark):
    sf = "/root/testdata/sf0.01"
    true = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = quality.op5_quality(spark, sf).collect()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    judged = [r for r in rows if r["held_out"] and r["doc_id"] in true]
    assert sum(r["predicted"] == true[r["doc_id"]] for r in judged) > 0.93 * len(judged)


# --- SpotSigs ---

def slow_signatures(text):
    words = [w for w in re.split(r"[\W_]+", text.lower()) if w]
    anchors = set(spotsigs.ANCHORS)
    out = set()
    for i, w in enumerate(words):
        after = [x for x in words[i + 1:] if x not in anchors][:3]
        if w in anchors and len(after) == 3:
            out.add((w, *after))
    return out or {tuple(words)}


def test_spotsigs_of_odd_rows(spark, odd):
    rows = sorted(docs_of(spark, odd), key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    got = sorted(spotsigs.op7_spotsigs(spark, odd).collect(),
                 key=lambda r: (r["doc_id"] is None, -(r["doc_id"] or 0), r["n_chars"]))
    by_text = {}
    for i, ((key, text), r) in enumerate(zip(rows, got)):
        text, after = text or "", rows[(i + 1) % len(rows)][1] or ""
        half = len(text) // 2
        new = text[:len(text) - half] + after[:half]
        assert (r["doc_id"], r["n_chars"]) == (key, len(text))
        assert r["edited_sha256"] == hashlib.sha256(new.encode()).hexdigest()
        assert by_text.setdefault(text, r["fingerprint"]) == r["fingerprint"]
        if " " not in text + new and "\x1c" not in text + new:
            a, b = slow_signatures(text), slow_signatures(new)
            assert r["near_edited"] == pytest.approx(len(a & b) / len(a | b))


def test_next_document_across_ranges(spark):
    keys = [5, 9, 1, 7, 7, 3, None, 20, 11]
    docs = spark.createDataFrame([(k, f"t{k}{i}") for i, k in enumerate(keys)],
                                 "doc_id long, text string")
    order = sorted(((k, f"t{k}{i}") for i, k in enumerate(keys)),
                   key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    for rows in (1, 2, 100):
        got = {r["text"]: r["next_text"] for r in
               spotsigs.with_next(docs, bucket_rows=rows).collect()}
        assert got == {order[i][1]: order[(i + 1) % len(order)][1] for i in range(len(order))}


def test_plan_does_not_grow_with_ranges(spark):
    rng = np.random.default_rng(4)
    keys = [*rng.integers(-2**63, 2**63 - 1, 2000).tolist(), -2**63, 2**63 - 1, None, None]
    keys += keys[:40] * 2
    rows = [(k, None if i % 50 == 9 else f"t{i % 7}{i}") for i, k in enumerate(keys)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(4).cache()
    few, many = (len(spotsigs.with_next(docs, bucket_rows=len(rows) // n)._jdf.queryExecution()
                     .analyzed().toString()) for n in (4, 40))
    assert many < few + 40 * 100                 # a range adds three numbers
    order = sorted(((k, t or "") for k, t in rows),
                   key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    want = Counter((k, t, order[(i + 1) % len(order)][1]) for i, (k, t) in enumerate(order))
    for n in (50, 2):
        assert Counter(map(tuple, spotsigs.with_next(docs, bucket_rows=n).collect())) == want
    docs.unpersist()


def test_near_duplicate_sets_against_all_pairs(spark):
    rng = np.random.default_rng(8)
    sets = [sorted(rng.choice(60, rng.integers(1, 25), False).tolist()) for _ in range(60)]
    sets += [sorted({*s[1:], 99}) for s in sets if len(s) > 3] + [s[:-1] for s in sets if len(s) > 5]
    sets = [list(s) for s in {tuple(s) for s in sets}]
    frame = spark.createDataFrame(list(enumerate(sets)), "id long, signatures array<long>")
    got = {(r["a"], r["b"]) for r in spotsigs.near_duplicates(frame).collect()}
    want = {(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets) if i < j
            and len(set(a) & set(b)) >= 0.8 * len(set(a) | set(b)) - 1e-9}
    assert got == want and want


# --- licences ---

def test_licences_of_odd_rows(spark, odd):
    texts = dict(docs_of(spark, odd))
    for r in licenses.op8_licenses(spark, odd).collect():
        if r["doc_id"] is None:
            continue
        low = re.sub("[A-Z]", lambda m: m[0].lower(), texts[r["doc_id"]] or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        at = {k: [i for i in range(len(words)) if words[i:i + len(p.split())] == p.split()]
              for k, p in licenses.PHRASES.items()}
        places = sorted(x for v in at.values() for x in v)
        assert (r["n_words"], r["n_base"]) == (len(words), len(places))
        assert r["first_word"] == (places[0] if places else None)
        assert r["last_word"] == (places[-1] if places else None)
        assert r["base_labels"] == ",".join(sorted(k for k in at if at[k]))
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))


def test_matching_statistics_against_search():
    rng = np.random.default_rng(6)
    sequences = [rng.integers(0, 4, 30).tolist() for _ in range(3)]
    text = rng.integers(0, 5, 200).tolist()
    lengths, states = (auto := licenses.Automaton(sequences)).statistics(text)
    for i, n in enumerate(lengths):
        inside = [k for k, s in enumerate(sequences) for m in [text[i + 1 - n:i + 1]]
                  if any(s[j:j + n] == m for j in range(len(s)))]
        longer = text[max(0, i - n):i + 1]
        assert not n or set(auto.ends[states[i]]) == set(inside)
        assert n > i or not any(s[j:j + n + 1] == longer for s in sequences for j in range(30 - n))


def test_a_template_with_changed_words_is_covered():
    words = licenses.TEMPLATES["bsd"].split()
    words[20], words[33] = "xx", "yy"
    got = licenses.Scanner().scan("Intro. " + " ".join(words) + " End.")
    assert got["labels"] == "bsd" and got["base_labels"] == "" and got["score"] > 0.8
    assert licenses.Scanner().scan(EN * 5)["labels"] == ""


# --- pipeline ---

def test_pipeline_stages(spark, odd, tmp_path):
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, odd).write.parquet(f"{tmp_path}/{name}")
        docs = kept[name] = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "packing":
            assert docs.columns == columns
    after = [r["text"] for r in kept["near_duplicates"].where("doc_id is not null").collect()]
    fps = [slow_fingerprint(t) for t in after]
    assert not any((a ^ b).bit_count() <= 3 for i, a in enumerate(fps) for b in fps[:i])
    assert all(any(ch.isalpha() for ch in t) for t in after)
    assert not any(slow_spans(r["text"]) for r in kept["personal_data"].collect())
    pieces = kept["packing"].collect()
    assert_gapless([(r["sequence_id"], r["offset"], r["length"]) for r in pieces], 2048)
    assert sum(r["piece"] == 0 for r in pieces) == kept["mixing"].count()


def test_pipeline_of_empty_tables(spark, empty):
    assert corpus_pipeline.run(spark, empty).count() == 0


@pytest.mark.parametrize("name", sorted(licenses.TEMPLATES))
def test_any_part_of_a_licence_is_labelled(name):
    words = licenses.TEMPLATES[name].split()
    n = len(words)
    parts = [words] if n < 40 else [words[:n // 2], words[n // 4:3 * n // 4], words[n // 2:],
                                    words[-30:]]
    for part in parts:
        text = "int main; " + " ".join(part).upper() + ". other words here"
        got = licenses.Scanner().scan(text)
        assert name in got["labels"].split(",")
        if not got["base_labels"]:
            assert got["labels"] == name and got["score"] >= 0.5
        spans = [x.split(":") for x in got["spans"].split(",")]
        assert spans[0][0] == name and int(spans[0][1]) <= 4 and int(spans[0][2]) >= len(part)
    few = licenses.Scanner().scan("x " + " ".join(words[:4]) + " y")
    assert few["labels"] == few["base_labels"] and few["spans"] == ""


def test_passages_of_two_licences_and_changed_words():
    mit, bsd = (licenses.TEMPLATES[k].split() for k in ("mit", "bsd"))
    changed = [("zz" if i % 17 == 9 else w) for i, w in enumerate(bsd)]
    got = licenses.Scanner().scan(" ".join(["a"] * 7 + mit[90:] + ["b"] * 20 + changed))
    assert got["labels"] == "bsd,mit" and got["base_labels"] == ""
    starts = {x.split(":")[0]: int(x.split(":")[1]) for x in got["spans"].split(",")}
    assert starts == {"mit": 7, "bsd": 7 + len(mit) - 90 + 20}
