"""Personal data by patterns and a skip-chain conditional random field.

Patterns give the base spans. Tokens that could be personal data (those with a digit or an at sign) are the nodes of
a field over each document: neighbours in the text are linked by chain edges, and distant tokens that are equal or
share half of their digits by skip edges. Sum-product messages run over the loopy graph; a token whose label is then
almost certain, and that no base span holds, adds a span. Potentials are fitted on base labels by pseudo-likelihood.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from floodspark.llm.common import stored

KINDS = ("email", "ip", "card", "phone")
LABELS = ("other", *KINDS)
SPANS = "doc_id long, base array<struct<kind:string,start:long,end:long>>, added array<struct<kind:string,start:long,end:long>>"
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]+\Z")
ADDRESS = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", re.ASCII)
DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])+")
CALL = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
TOKEN = re.compile(r"\S+")
MARKED = re.compile(r"[0-9@]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
EDGES = "\"'`,;:!?*#$%&|<>[]{}=~^_/\\"


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Leftmost non-overlapping matches of each kind that pass its test, by kind and start.

    A match that fails its test is dropped without another try inside it. Work is linear in the text: a local part is
    read backwards from its at sign, and numbers are tried only from their first digit.
    """
    found = []
    done = 0
    for m in DOMAIN.finditer(text) if "@" in text else ():
        if m.start() < done:
            continue
        start = m.start()
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < m.start():
            found.append(("email", start, m.end()))
            done = m.end()
    for m in ADDRESS.finditer(text):
        if all(len(p) <= 3 and int(p) <= 255 for p in (part.lstrip("0") or "0" for part in m[0].split("."))):
            found.append(("ip", m.start(), m.end()))
    for m in DIGITS.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", m.start(), m.end()))
    for m in CALL.finditer(text) if "+" in text else ():
        if 8 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
            found.append(("phone", m.start(), m.end()))
    return found


def nodes(text: str) -> list[tuple[int, int]]:
    """Bounds of the tokens that could be personal data, without surrounding punctuation."""
    out = []
    for m in TOKEN.finditer(text) if MARKED.search(text) else ():
        token = m[0]
        if "@" in token or any(c in token for c in "0123456789"):
            bare = token.rstrip(EDGES + ".")
            start = m.start() + len(bare) - len(bare.lstrip(EDGES))
            if start < m.start() + len(bare):
                out.append((start, m.start() + len(bare)))
    return out


def shape(token: str) -> str:
    """What a token looks like: digits as 9 with long runs counted, letters as a, whether its check digit fits."""
    if "@" in token:
        return "@." if "." in token.rpartition("@")[2] else "@"
    if token.isascii() and token.isdigit():
        return f"9x{min(len(token), 20)}{'L' if len(token) >= 12 and luhn(token) else ''}"
    if len(token) > 24:
        return "long"
    return re.sub(r"[^\W\d_]+", "a", re.sub(r"[0-9]+", lambda m: f"9{min(len(m[0]), 5)}", token))


def same_keys(token: str) -> list[str]:
    """Tokens that share a key are linked: equal ones, and those with an equal half of seven digits or more."""
    digits = re.sub(r"[^0-9]", "", token)
    keys = ["=" + token.casefold()]
    if len(digits) >= 7 and "@" not in token:
        half = len(digits) // 2
        keys += [f"<{len(digits)}:{digits[:half]}", f">{len(digits)}:{digits[half:]}"]
    return keys


def graph(text: str, found: list[tuple[int, int]]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Chain edges between tokens at most 3 characters apart, and skip edges to the last token with the same key.

    Equal tokens form a path, not a clique: edges are at most four times the tokens.
    """
    chain = [(k - 1, k) for k in range(1, len(found)) if found[k][0] - found[k - 1][1] <= 3]
    near, skip, last = set(chain), [], {}
    for k, (a, b) in enumerate(found):
        for key in same_keys(text[a:b]):
            j = last.get(key)
            if j is not None and (j, k) not in near:
                near.add((j, k))
                skip.append((j, k))
            last[key] = k
    return chain, skip


def base_labels(found: list[tuple[int, int]], spans: list[tuple[str, int, int]]) -> np.ndarray:
    """The label of each token from the base spans that overlap it, 0 where none does."""
    out = np.zeros(len(found), np.int64)
    if spans and found:
        starts, ends = np.array(found).T
        for kind, a, b in reversed(spans):
            out[np.searchsorted(ends, a, "right"):np.searchsorted(starts, b, "left")] = LABELS.index(kind)
    return out


def fit(docs: DataFrame, max_docs: int = 20_000, max_configs: int = 20_000, rounds: int = 300) -> dict:
    """Potentials by pseudo-likelihood of base labels: of a shape and label, of chain and of skip neighbours' labels.

    ``max_docs`` bounds the sample (documents with the smallest hash of the key), ``max_configs`` the distinct
    situations that reach the driver, most frequent first.
    """
    n = docs.count()
    sample = docs if n <= max_docs else docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 32)) < int(max_docs / n * (1 << 32)))

    def situations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter = Counter()
            for text in batch.column(0).to_pylist():
                found = nodes(text or "")
                labels = base_labels(found, base_spans(text or "")).tolist() if found else []
                chain, skip = graph(text, found) if found else ((), ())
                sides = [[[0] * len(LABELS), [0] * len(LABELS)] for _ in found]
                for way, edges in enumerate((chain, skip)):
                    for j, k in edges:
                        sides[j][way][labels[k]] += 1
                        sides[k][way][labels[j]] += 1
                for (a, b), label, (left, right) in zip(found, labels, sides):
                    seen[shape(text[a:b]), label, *(min(c, 3) for c in left + right)] += 1
            rows = [(k[0], k[1], list(k[2:]), c) for k, c in seen.items()]
            columns = zip(*rows) if rows else ((),) * 4
            kinds = (pa.string(), pa.int32(), pa.list_(pa.int32()), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["shape", "label", "around", "n"])

    seen = stored(sample.select("text").mapInArrow(situations, "shape string, label int, around array<int>, n long")
                  .groupBy("shape", "label", "around").agg(F.sum("n").alias("n")), "situations")
    rows = seen.orderBy(F.desc("n"), "shape", "label", "around").limit(max_configs).toPandas()
    return _climb(rows, rounds)


def _climb(rows, rounds: int) -> dict:
    """Gradient ascent of the penalised pseudo-likelihood over the counted situations."""
    shapes = {s: k for k, s in enumerate(sorted(rows["shape"].unique()))}
    L = len(LABELS)
    own, chain, skip = np.zeros((len(shapes), L)), np.zeros((L, L)), np.zeros((L, L))
    if len(rows):
        s, y, n = rows["shape"].map(shapes).to_numpy(), rows["label"].to_numpy(), rows["n"].to_numpy(float)
        around = np.stack(rows["around"].to_list()).astype(float)
        left, right = around[:, :L], around[:, L:]
        per_shape = np.zeros(len(shapes))
        np.add.at(per_shape, s, n)
        for _ in range(rounds):
            score = own[s] + left @ chain + right @ skip
            p = np.exp(score - score.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            gap = -p * n[:, None]
            gap[np.arange(len(y)), y] += n
            step = np.zeros_like(own)
            np.add.at(step, s, gap)
            own += step / (per_shape[:, None] + 1) - 0.001 * own
            for table, side in ((chain, left), (skip, right)):
                g = side.T @ gap
                table += 0.5 * (g + g.T) / (n @ side.sum(1) + 1) - 0.001 * table
    return {"shapes": shapes, "own": own, "chain": chain, "skip": skip}


def propagate(unary: np.ndarray, edges: np.ndarray, tables: np.ndarray, rounds: int = 10) -> np.ndarray:
    """Label probabilities by sum-product messages on a loopy graph, all edges at once, damped by half.

    ``edges`` lists node pairs, ``tables`` the log potential of each; a tree of up to ``rounds`` steps is exact up to
    the damping.
    """
    if not len(edges):
        belief = unary
    else:
        src, dst = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
        pair = np.concatenate([tables, tables.transpose(0, 2, 1)])
        back = np.roll(np.arange(len(src)), len(edges))
        sent = np.zeros((len(src), unary.shape[1]))
        for _ in range(rounds + 1):
            belief = unary.copy()
            np.add.at(belief, dst, sent)
            out = (belief[src] - sent[back])[:, :, None] + pair
            top = out.max(1)
            out = top + np.log(np.exp(out - top[:, None, :]).sum(1))
            sent = 0.5 * sent + 0.5 * (out - out.max(1, keepdims=True))
    p = np.exp(belief - belief.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def added_spans(text: str, base: list[tuple[str, int, int]], model: dict, certain: float = 0.9) -> list[tuple[str, int, int]]:
    """Spans of tokens outside the base spans whose label the field is certain of; neighbours of a label are joined."""
    found = nodes(text)
    if not found:
        return []
    labels = base_labels(found, base)
    chain, skip = graph(text, found)
    unknown = np.full(len(LABELS), -1.0)
    unknown[0] = 0.0
    unary = np.stack([model["own"][k] if (k := model["shapes"].get(shape(text[a:b]))) is not None else unknown for a, b in found])
    fixed = np.flatnonzero(labels)
    unary[fixed] -= 30.0
    unary[fixed, labels[fixed]] += 30.0
    edges = np.array(chain + skip, np.int64).reshape(-1, 2)
    tables = np.concatenate([np.broadcast_to(model[w], (len(e), *model[w].shape)) for w, e in (("chain", chain), ("skip", skip))])
    p = propagate(unary, edges, tables)
    best = np.where((p.max(1) >= certain) & (labels == 0), p.argmax(1), 0)
    out: list[tuple[str, int, int]] = []
    linked = {k for j, k in chain}
    for k in np.flatnonzero(best):
        kind, (a, b) = LABELS[best[k]], found[k]
        if out and k in linked and best[k - 1] == best[k] and out[-1][0] == kind:
            out[-1] = (kind, out[-1][1], b)
        else:
            out.append((kind, a, b))
    return out


def find_pii(docs: DataFrame, model: dict) -> DataFrame:
    """One row per document: doc_id, base spans, added spans (kind, start, end; code points, end exclusive).

    Null text is empty: no spans. Rows repeat as they are; a null doc_id is kept; other columns are never read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        named = lambda s: [{"kind": k, "start": a, "end": b} for k, a, b in s]
        for batch in batches:
            base, added = [], []
            for value in batch.column(1):
                text = value.as_py() or ""
                spans = base_spans(text)
                base.append(named(spans))
                more = added_spans(text, spans, shared.value)
                added.append(named(sorted(more, key=lambda s: (KINDS.index(s[0]), s[1]))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, span), pa.array(added, span)], names=["doc_id", "base", "added"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, SPANS)


def mask_pii(docs: DataFrame, model: dict) -> DataFrame:
    """The documents with every span, base or added, replaced by its kind in brackets; n_chars follows.

    Overlapping spans become one, named after the first. Null text stays null; all columns stay in place.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts = [masked(v.as_py(), shared.value) for v in batch.column(at)]
            columns = [pa.array(texts, pa.string()) if k == at else
                       pa.array([None if t is None else len(t) for t in texts], c.type) if batch.schema.names[k] == "n_chars" else c
                       for k, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.mapInArrow(work, docs.schema)


def masked(text: str | None, model: dict) -> str | None:
    if not text:
        return text
    base = base_spans(text)
    out, at = [], 0
    for kind, a, b in sorted(base + added_spans(text, base, model), key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join(out) + text[at:]
