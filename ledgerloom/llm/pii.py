"""Personal data: fixed patterns, and a linear-chain conditional random field for the rest.

The field is trained on the small labelled table below and labels whitespace-separated tokens
by their shape and neighbours. Tokens with neither a digit nor an `@` are held at label O, which
cuts a text into short independent chains; these are decoded by Viterbi in numpy batches.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as c

KINDS = ("email", "ip", "card", "phone")
LABELS = ("O", *KINDS)

# The labelled table. [kind:...] marks the tokens of a label.
LABELLED = """
write to [email:john.smith@example.org] for details
mail [email:a_b+c@mail.example.co.uk], please
my address is [email:<jane@host.net>] and yours
contact [email:sales@localhost] or the desk
send it to [email:info@intranet] today
email [email:(bob@server)] again
reply to [email:x.y@corp] soon
from [email:ops@example.com;] to all
call [phone:+1 (555) 010-2030] now
phone [phone:+44 20 7946 0018] in london
tel [phone:(555) 010-2030] at noon
telephone: [phone:(020) 7946 0018] or write
call me on [phone:555-010-2030] tomorrow
mobile [phone:07700 900 123] after six
fax [phone:01632-960-001] is off
ring [phone:030 901820] in berlin
call [phone:06 12 34 56 78] for french
phone [phone:555.010.2030] ext
numero [phone:(93) 412-3456] por favor
tel: [phone:0049 30 901820] bitte
server [ip:192.168.0.1] is down
from host [ip:10.20.30.40] at night
ping [ip:8.8.8.8] twice
ip [ip:172.16.254.1:8080] refused
address [ip:[203.0.113.7]] blocked
login from [ip:198.51.100.23:22] failed
card [card:4111 1111 1111 1111] expired
pay with [card:4111-1111-1111-1111] now
visa [card:4012888888881881] was used
card number [card:5500 0000 0000 0004] is mine
credit card [card:5105105105105100] stolen
kreditkarte [card:4000 1234 5678 9017] gesperrt
tarjeta [card:6011000990139424] robada
the year 1999 was good
in 2020 and 2021 we met
at 10:30 on 12 may
page 42 of 300
chapter 3 section 4
price 19.99 or 20
about 3.5 percent of 100
version 3 of the licence
version 2.0.1 is out
released 1.2.3 and 1.2.4
on 2021-05-17 it rained
born 17.05.1980 in rome
from 12/05/2019 to 13/05/2019
order 123456 shipped
it cost 1,200 dollars
follow @name and @other
room 101 on floor 5
1 2 3 4 5 6 7
10 20 30 40 50
the ratio 16:9 and 4:3
score 3-1 after 90 minutes
isbn 978-3-16-148410-0 is a book
section 1.1 and 1.2 and 1.3
iso 9001 and 27001
http://example.com/a1 and b2
x1 y2 z3
80% of 1000
item #42 and #43
100000 people came
""".strip().splitlines()

EMAIL_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
EMAIL_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
HIT = re.compile(r"[0-9@]\S*")
_TRIM = ".,;:!?\"'<>[]{}"


def luhn(digits: str) -> bool:
    total = 0
    for i, ch in enumerate(reversed(digits)):
        d = int(ch) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """The leftmost non-overlapping matches, found from each @ outwards in linear time."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        before = text[free:at]
        local = len(before) - len(before.rstrip(EMAIL_LOCAL))
        m = EMAIL_DOMAIN.match(text, at + 1) if local else None
        if m:
            out.append((at - local, m.end()))
            free = m.end()
        else:
            free = at + 1
        at = text.find("@", at + 1)
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the fixed patterns, by kind and then start, in code points."""
    out = [("email", s, e) for s, e in emails(text)] if "@" in text else []
    first = re.search("[0-9]", text)
    if not first:
        return out
    at = max(0, first.start() - 1)
    out += [("ip", *m.span()) for m in IP.finditer(text, at)
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255
                   for p in m[0].split("."))]
    for m in CARD.finditer(text, at):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in PHONE.finditer(text, at)
                if 8 <= sum(map(m[0].count, "0123456789")) <= 15]
    return out


# --- the conditional random field ---------------------------------------------------------

def shape(token: str, collapse: bool) -> str:
    s = re.sub(r"[^\W\d_]", "a", re.sub("[0-9]", "0", token[:40]))
    return re.sub(r"(.)\1+", r"\1", s) if collapse else s


def features(token: str, before: str, after: str) -> list[str]:
    """before, after: the neighbouring tokens, empty at a text's ends."""
    digits = sum(map(token.count, "0123456789"))
    near = before.strip(_TRIM + "()").lower()
    return ["bias", "s=" + shape(token, True), "l=" + shape(token, False),
            f"digits={min(digits, 20)}", f"many={digits >= 7}", f"card={13 <= digits <= 19}",
            f"at={0 < token.find('@') < len(token) - 1}", f"dots={min(token.count('.'), 4)}",
            "first=" + shape(token[:1], True), "before=" + (near if near.isalpha() else "#"),
            "bs=" + shape(before, True), "as=" + shape(after, True)]


def labelled_tokens(lines: list[str]) -> list[list[tuple[str, str]]]:
    """(token, label) of each line of the labelled table."""
    out = []
    for line in lines:
        row, at = [], 0
        for m in re.finditer(r"(?<!\S)\[(\w+):(.+?)\](?= |,|$)(?!\])", line):
            row += [(t, "O") for t in line[at:m.start()].split()]
            row += [(t, m[1]) for t in m[2].split()]
            at = m.end()
        row += [(t, "O") for t in line[at:].split() if t != ","]
        out.append(row)
    return out


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis))


def train(lines: list[str] = LABELLED, steps: int = 250, rate: float = 0.1, decay: float = 2e-3
          ) -> tuple[dict[str, int], np.ndarray, np.ndarray]:
    """Feature numbers, feature weights by label, and transition weights.

    Penalised likelihood by Adam over all lines at once; no randomness. A chain starts and ends
    next to O.
    """
    rows = labelled_tokens(lines)
    feats = [[features(t, r[i - 1][0] if i else "", r[i + 1][0] if i + 1 < len(r) else "")
              for i, (t, _) in enumerate(r)] for r in rows]
    index = {f: i for i, f in enumerate(sorted({f for r in feats for x in r for f in x}))}
    n, longest, k = len(rows), max(map(len, rows)), len(LABELS)
    x = np.zeros((n, longest, len(index)))
    gold = np.zeros((n, longest), int)
    mask = np.zeros((n, longest), bool)
    for i, r in enumerate(rows):
        mask[i, :len(r)] = True
        for j, (_, label) in enumerate(r):
            gold[i, j] = LABELS.index(label)
            x[i, j, [index[f] for f in feats[i][j]]] = 1
    want = x.reshape(-1, len(index)).T @ (np.eye(k)[gold] * mask[..., None]).reshape(-1, k)
    ends = mask.sum(1)
    want_t = np.zeros((k, k))
    for i in range(n):
        path = [0, *gold[i, :ends[i]], 0]
        np.add.at(want_t, (path[:-1], path[1:]), 1)
    w, t = np.zeros((len(index), k)), np.zeros((k, k))
    moments = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(t), np.zeros_like(t)]
    for step in range(1, steps + 1):
        e = x @ w
        alpha, beta = np.zeros((n, longest, k)), np.zeros((n, longest, k))
        alpha[:, 0] = e[:, 0] + t[0]
        for j in range(1, longest):
            alpha[:, j] = e[:, j] + _log_sum(alpha[:, j - 1, :, None] + t, 1)
        for j in range(longest - 1, -1, -1):
            inner = _log_sum(t + (e[:, j + 1] + beta[:, j + 1])[:, None, :], 2) \
                if j + 1 < longest else np.zeros((n, k))
            beta[:, j] = np.where((j + 1 == ends)[:, None], t[:, 0], inner)
        z = _log_sum(alpha[:, 0] + beta[:, 0], 1)
        p = np.exp(alpha + beta - z[:, None, None]) * mask[..., None]
        got_t = np.zeros((k, k))
        got_t[0] += p[:, 0].sum(0)
        got_t[:, 0] += p[np.arange(n), ends - 1].sum(0)
        for j in range(1, longest):
            pair = np.exp(alpha[:, j - 1, :, None] + t + (e[:, j] + beta[:, j])[:, None, :]
                          - z[:, None, None])
            got_t += (pair * mask[:, j, None, None]).sum(0)
        got = x.reshape(-1, len(index)).T @ p.reshape(-1, k)
        for q, grad, m, v in ((w, (got - want) / n + decay * w, *moments[:2]),
                              (t, (got_t - want_t) / n + decay * t, *moments[2:])):
            m += 0.1 * (grad - m)
            v += 0.001 * (grad ** 2 - v)
            q -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    return index, w, t


def viterbi(emit: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Best labels (n x length) of n chains of one length; emit: n x length x labels."""
    n, length, _ = emit.shape
    score, back = emit[:, 0] + t[0], []
    for j in range(1, length):
        step = score[:, :, None] + t
        back.append(step.argmax(1))
        score = emit[:, j] + step.max(1)
    path = np.zeros((n, length), int)
    path[:, -1] = (score + t[:, 0]).argmax(1)
    for j in range(length - 2, -1, -1):
        path[:, j] = back[j][np.arange(n), path[:, j + 1]]
    return path


def chains(text: str) -> list[list[tuple[int, int, list[str]]]]:
    """Runs of neighbouring tokens with a digit or @: (start, end, features) of each token."""
    tokens, free = [], 0
    m = HIT.search(text)
    while m:
        before = text[free:m.start()]
        start = m.start() - (len(before) - len(_last_space(before)))
        tokens.append((start, m.end()))
        free = m.end()
        m = HIT.search(text, free)
    out: list[list[tuple[int, int, list[str]]]] = []
    last = -1
    for i, (s, e) in enumerate(tokens):
        left = text[max(0, s - 80):s].split()
        right = text[e:e + 80].split(None, 1)
        row = (s, e, features(text[s:e], left[-1] if left else "", right[0] if right else ""))
        if last >= 0 and not text[last:s].strip():
            out[-1].append(row)
        else:
            out.append([row])
        last = e
    return out


def _last_space(s: str) -> str:
    """s without its last run of non-space characters."""
    m = re.search(r"\S+\Z", s[-4096:])
    if not m:
        return s
    if len(s) > 4096 and m.end() - m.start() == 4096:
        return s[:max(map(s.rfind, " \t\n\r\x0b\x0c")) + 1]
    return s[:len(s) - (m.end() - m.start())]


def found_by_field(texts: list[str], model) -> list[list[tuple[str, int, int]]]:
    """Spans of each text by the field alone, trimmed of surrounding punctuation."""
    index, w, t = model
    all_chains = [(i, ch) for i, x in enumerate(texts) if HIT.search(x) for ch in chains(x)]
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    by_length: dict[int, list[int]] = {}
    for a, (_, ch) in enumerate(all_chains):
        by_length.setdefault(len(ch), []).append(a)
    for length, members in by_length.items():
        step = max(1, 20000 // length)
        for at in range(0, len(members), step):
            part = members[at:at + step]
            emit = np.array([[w[[index[f] for f in tok[2] if f in index]].sum(0)
                              for tok in all_chains[a][1]] for a in part])
            for a, path in zip(part, viterbi(emit, t)):
                i, ch = all_chains[a]
                j = 0
                while j < length:
                    k = j
                    while k + 1 < length and path[k + 1] == path[j]:
                        k += 1
                    if path[j]:
                        s, e = ch[j][0], ch[k][1]
                        while s < e and texts[i][s] in _TRIM:
                            s += 1
                        while e > s and texts[i][e - 1] in _TRIM + "()":
                            e -= 1
                        if s < e:
                            out[i].append((LABELS[path[j]], s, e))
                    j = k + 1
    return out


def plausible(kind: str, span: str) -> bool:
    """The exact check after the field: a card passes Luhn, an address has four parts to 255."""
    if kind == "card":
        return luhn(re.sub("[^0-9]", "", span))
    if kind == "ip":
        parts = re.findall("[0-9]+", span)
        return len(parts) >= 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts[:4])
    return True


def all_spans(texts: list[str | None], model) -> list[tuple[list, list]]:
    """(base spans, all spans) of each text. The field's spans count where no base span is."""
    plain = [x or "" for x in texts]
    result = []
    for text, extra in zip(plain, found_by_field(plain, model)):
        base = base_spans(text)
        more = [x for x in extra if plausible(x[0], text[x[1]:x[2]])
                and all(x[2] <= s or x[1] >= e for _, s, e in base)]
        both = sorted(base + more, key=lambda x: (KINDS.index(x[0]), x[1], x[2]))
        result.append((base, both))
    return result


def spell(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def mask(text: str, spans: list[tuple[str, int, int]]) -> str:
    """text with every span replaced by its kind; spans that overlap go as one."""
    out, at = [], 0
    for kind, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= at:
            out += [text[at:s], f"[{kind.upper()}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def find(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, base, spans) of every row: spelled spans, by kind as listed and then start.

    Null and empty texts have none; repeated rows come back as often as they came, and keys may be
    null or shared. A very long text is read whole, in one task; tokens count by their first 40
    characters, and those without a digit or @ are no part of a chain. Other columns are left out,
    whatever their names.
    """
    model = docs.sparkSession.sparkContext.broadcast(train())

    def rows(cols: dict[str, pa.Array]) -> dict[str, list]:
        got = all_spans(cols["t"].to_pylist(), model.value)
        return {"id": cols["id"], "base": [spell(b) for b, _ in got],
                "spans": [spell(a) for _, a in got],
                **{f"n_{k}": [sum(x[0] == k for x in b) for b, _ in got] for k in KINDS},
                "base_sha256": [hashlib.sha256(spell(b).encode()).hexdigest() for b, _ in got]}

    counts = ", ".join(f"n_{k} long" for k in KINDS)
    found = c.map_arrow(docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("t")),
                        rows, f"id long, base string, spans string, {counts}, base_sha256 string")
    return found.withColumnRenamed("id", key)


def redact(docs: DataFrame, text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """docs with every span masked in the text, and n_chars (if there) counted anew.

    A null text stays null; texts without spans stay as they are.
    """
    model = docs.sparkSession.sparkContext.broadcast(train())
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in docs.schema])
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            new = [x if x is None else mask(x, spans)
                   for x, (_, spans) in zip(texts, all_spans(texts, model.value))]
            cols = list(batch.columns)
            cols[at] = pa.array(new, cols[at].type)
            yield pa.RecordBatch.from_arrays(cols, names=batch.schema.names)

    out = docs.mapInArrow(run, schema)
    if n_chars in docs.columns:
        out = out.withColumn(n_chars, F.length(text).cast(docs.schema[n_chars].dataType))
    return out


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(c.table(spark, sf_dir, "documents"))
    return found.select("doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans")


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: personal data is masked; every document stays."""
    return redact(docs).select(*docs.columns)
