"""Quality rules with line sequence labelling.

A linear-chain conditional random field with two states (content, boilerplate) reads one feature
vector per line; Viterbi decoding labels the lines and the share of characters in content lines
decides whether a document stays. Counting rules that need no labels come first.

Defined results: a null or empty text has no words, fails the base rule and goes; lines without a
word are neither content nor boilerplate; repeated rows get equal results row by row; an empty
table gives an empty result; extra columns are ignored by `quality_rules`; whole texts of any length
are read, one at a time; ties between states go to content. No window or join is used, so one hot
source or very long text stays a matter of its own row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from lorekeep.llm.common import slices, table

CONTENT, BOILERPLATE = 0, 1
FEATURES = 12
#: Used when there are no labels of both kinds: symbols, shouting, table bars and digits speak for boilerplate.
DEFAULT_MODEL = {
    "weights": [-4.0, 0.0, 3.0, 20.0, 4.0, 4.0, 3.0, 1.0, -1.0, 0.5, 0.0, 1.0],
    "transitions": [[0.5, -0.5], [-0.5, 0.5]],
}

_UPPER = bytes(range(65, 91))
_SYMBOLS = b"#*$%&|<>"
_DIGITS = b"0123456789"


def line_features(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Features of the lines that have a word, and those lines' numbers of bytes."""
    rows, sizes, seen = [], [], set()
    for line in lines:
        words = line.split()
        if not words:
            continue
        n, m = len(line), len(words)
        upper = n - len(line.translate(None, _UPPER))
        symbols = n - len(line.translate(None, _SYMBOLS))
        digits = n - len(line.translate(None, _DIGITS))
        rows.append((
            1.0, min(np.log1p(m), 6.0) / 6.0, upper / n, symbols / n, min(1.0, line.count(b"!") / m), line.count(b"|") / m if line.count(b"|") < m else 1.0,
            digits / n, 1.0 - len(set(words)) / m, float(words[-1][-1:] in b".!?"), float(line in seen), min(n / m, 20.0) / 20.0, float(line.islower()),
        ))
        seen.add(line)
        sizes.append(n)
    return np.array(rows, np.float32).reshape(-1, FEATURES), np.array(sizes, np.int64)


def viterbi(scores: np.ndarray, transitions: list[list[float]]) -> np.ndarray:
    """Best states of one chain; scores are of state 1 against state 0. Ties go to content."""
    (aa, ab), (ba, bb) = transitions
    back: list[tuple[bool, bool]] = []
    a = b = None
    for s in scores.tolist():
        if a is None:
            a, b = 0.0, s
            continue
        from_b, stay_b = b + ba > a + aa, b + bb >= a + ab
        back.append((from_b, stay_b))
        a, b = (b + ba if from_b else a + aa), s + (b + bb if stay_b else a + ab)
    if a is None:
        return np.zeros(0, np.int8)
    states = [int(b > a)]
    for from_b, stay_b in reversed(back):
        states.append(int(stay_b if states[-1] else from_b))
    return np.array(states[::-1], np.int8)


def repeated_words(words: list[bytes]) -> int:
    """Words inside a 3-word window that occurs twice or more."""
    if len(words) < 4:
        return 0
    ids: dict[bytes, int] = {}
    v = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    pair = v[:-1] * len(ids) + v[1:]
    if len(ids) > 1_000_000:
        pair = np.unique(pair, return_inverse=True)[1].astype(np.int64)
    code = pair[:-1] * len(ids) + v[2:]
    order = np.argsort(code, kind="stable")
    same = code[order][1:] == code[order][:-1]
    hit = np.zeros(len(code), bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[k : k + len(code)] |= hit
    return int(covered.sum())


def base_counts(text: str, raw: bytes, lines: list[bytes]) -> tuple[int, int, int, int, int]:
    words = raw.split()
    blank = sum(raw.count(c) for c in (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r"))
    seen: set[bytes] = set()
    dup = 0
    for line in lines:
        if line in seen:
            dup += 1
        elif line and line.split(None, 1):
            seen.add(line)
    return len(words), len(text) - blank, len(raw) - len(raw.translate(None, _SYMBOLS)), dup, repeated_words(words)


def _rules_udf(model: dict, min_share: float):
    weights, transitions = np.array(model["weights"], np.float32), model["transitions"]

    @arrow_udf("struct<n_words:bigint,word_chars:bigint,n_symbols:bigint,n_dup_lines:bigint,n_repeat_words:bigint,content_share:double,base_failed:boolean,kept:boolean>")
    def rules(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            rows = []
            for part in slices(texts):
                for text in part:
                    raw = text.encode("utf-8", "surrogatepass")
                    lines = raw.split(b"\n")
                    n, chars, symbols, dup, repeat = base_counts(text, raw, lines)
                    failed = n < 50 or 100 * repeat > 50 * n
                    x, sizes = line_features(lines)
                    share = float(sizes[viterbi(x @ weights, transitions) == CONTENT].sum() / sizes.sum()) if len(sizes) else 0.0
                    rows.append((n, chars, symbols, dup, repeat, share, failed, not failed and share >= min_share))
            names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "content_share", "base_failed", "kept"]
            kinds = [pa.int64()] * 5 + [pa.float64(), pa.bool_(), pa.bool_()]
            yield pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 8, kinds)], names=names)

    return rules


def _features(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in batches:
        found = [line_features(t.encode("utf-8", "surrogatepass").split(b"\n"))[0] for part in slices(texts) for t in part]
        yield pa.StructArray.from_arrays([pa.array([len(x) for x in found], pa.int32()), pa.array([x.tobytes() for x in found], pa.binary())], names=["rows", "features"])


def fit_crf(chains: list[np.ndarray], bad: np.ndarray, epochs: int = 60, rounds: int = 3) -> dict:
    """Conditional log-likelihood by gradient ascent on weakly labelled chains.

    All lines of good documents are content. Lines of bad documents start as boilerplate; after
    each round those that the model reads as content, because good documents hold the like, are
    relabelled.
    """
    t = max(len(c) for c in chains)
    x = np.zeros((len(chains), t, FEATURES), np.float32)
    mask = np.zeros((len(chains), t), bool)
    for i, c in enumerate(chains):
        x[i, : len(c)] = c
        mask[i, : len(c)] = True
    y = np.where(bad[:, None], mask, False).astype(np.int8)
    w, tr = np.zeros(FEATURES), np.zeros((2, 2))
    scale = 1.0 / max(1, mask.sum())
    for _ in range(rounds):
        m, v = np.zeros(FEATURES + 4), np.zeros(FEATURES + 4)
        for step in range(1, epochs + 1):
            p1, pair = _marginals(x @ w, tr, mask)
            gw = np.einsum("dt,dtf->f", np.where(mask, y - p1, 0.0), x) * scale
            real = np.zeros((2, 2))
            both = mask[:, 1:]
            for a in (0, 1):
                for b in (0, 1):
                    real[a, b] = ((y[:, :-1] == a) & (y[:, 1:] == b) & both).sum()
            g = np.concatenate([gw - 1e-4 * w, ((real - pair) * scale).ravel() - 1e-4 * tr.ravel()])
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            d = 0.3 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
            w, tr = w + d[:FEATURES], tr + d[FEATURES:].reshape(2, 2)
        p1, _ = _marginals(x @ w, tr, mask)
        y = (np.where(bad[:, None], p1 > 0.5, False) & mask).astype(np.int8)
    return {"weights": w.tolist(), "transitions": tr.tolist()}


def _marginals(s: np.ndarray, tr: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(state 1) at each line and expected transition counts, by forward-backward in logs."""
    d, t = s.shape
    e = np.stack([np.zeros_like(s), s], -1)
    alpha, beta = np.zeros((d, t, 2)), np.zeros((d, t, 2))
    alpha[:, 0] = e[:, 0]
    for i in range(1, t):
        alpha[:, i] = e[:, i] + np.logaddexp(alpha[:, i - 1, 0:1] + tr[0], alpha[:, i - 1, 1:2] + tr[1])
        alpha[:, i] = np.where(mask[:, i, None], alpha[:, i], alpha[:, i - 1])
    for i in range(t - 2, -1, -1):
        nxt = e[:, i + 1] + beta[:, i + 1]
        beta[:, i] = np.where(mask[:, i + 1, None], np.logaddexp(nxt[:, 0:1] + tr[:, 0], nxt[:, 1:2] + tr[:, 1]), beta[:, i + 1])
    z = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])
    p1 = np.exp(np.minimum(alpha[:, :, 1] + beta[:, :, 1] - z[:, None], 0.0))
    pair = np.zeros((2, 2))
    if t > 1:
        for a in (0, 1):
            for b in (0, 1):
                lp = alpha[:, :-1, a] + tr[a, b] + e[:, 1:, b] + beta[:, 1:, b] - z[:, None]
                pair[a, b] = np.exp(np.where(mask[:, 1:], np.minimum(lp, 0.0), -np.inf)).sum()
    return p1, pair


def train(docs: DataFrame, labels: DataFrame, max_docs: int = 1500, chain: int = 150) -> dict:
    """Fit the field on a bounded sample of labelled rows: about `max_docs` of them, chosen by the
    hash of their id. Their whole texts become chains of at most `chain` lines, of which at most
    2 * max_docs, evenly spread, are fitted. Only features reach the driver."""
    labels = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").select("doc_id", "quality")
    n = labels.count()
    if n == 0:
        return DEFAULT_MODEL
    share = int(min(1.0, max_docs / n) * 1_000_000)
    sample = labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share).dropDuplicates(["doc_id"])
    sample = sample.orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * max_docs)
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("quality", arrow_udf(_features, "struct<rows:int,features:binary>")("text").alias("f")).select("quality", "f.rows", "f.features")
    rows = rows.where("rows > 0").orderBy(F.xxhash64("features"), "quality").limit(4 * max_docs).collect()  # an id may have many rows
    chains, bad = [], []
    for r in rows:
        x = np.frombuffer(r["features"], np.float32).reshape(-1, FEATURES)
        for k in range(0, len(x), chain):
            chains.append(x[k : k + chain])
            bad.append(r["quality"] == 0)
    step = max(1, -(-len(chains) // (2 * max_docs)))
    chains, bad = chains[::step], bad[::step]
    if not chains or not any(bad) or all(bad):
        return DEFAULT_MODEL
    return fit_crf(chains, np.array(bad))


def quality_rules(docs: DataFrame, model: dict | None = None, min_share: float = 0.5) -> DataFrame:
    """One row per document: counts, content share, base_failed, kept."""
    d = docs.select("doc_id", _rules_udf(model or DEFAULT_MODEL, min_share)("text").alias("r"))
    return d.select("doc_id", "r.*")


def keep_good(docs: DataFrame, model: dict | None = None, min_share: float = 0.5) -> DataFrame:
    """The documents that the rules keep, with the columns they came with."""
    verdict = _rules_udf(model or DEFAULT_MODEL, min_share)("text")["kept"]
    return docs.where(verdict)


def op4_line_labels(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_rules(docs, train(docs, table(spark, sf_dir, "labels")))
