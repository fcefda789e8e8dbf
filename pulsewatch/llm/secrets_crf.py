"""Secret spans: exact patterns plus a linear-chain conditional random field.

Tokens are tagged secret-begin, inside or outside from their shape, the
neighbouring tokens and features of the file, decoded by Viterbi.  The field
learns from weak labels: the spans of the exact patterns in a bounded sample
of distinct texts (``max_docs``, chosen by a hash of the text), cut to distinct
windows around secrets and around other tokens with digits.

Decoding covers every token of every whole text.  A token whose outside score
beats both other tags by more than any change of the transitions could win
back is outside on the best path for certain, so only the stretches between
such tokens go through Viterbi.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import claim, map_texts, ship, staged, whole_text

KINDS = ("assign", "access", "hex", "crf")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # a run shorter than 32 fails at every start in it
TOKEN = re.compile(r"[\w+/.-]+|[^\w\s+/.-]")
KEYWORD = re.compile(r"passw|secret|token|api_?key|credential|private_?key|auth|bearer", re.I)
B, I, O = 0, 1, 2  # noqa: E741
WINDOW = 8
TABLE_ENTRIES = 300_000


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the exact patterns, by start, then kind as listed;
    leftmost non-overlapping matches per kind, failing ones dropped."""
    out = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def shape_features(token: str) -> list[str]:
    """Features of a token by its shape alone."""
    n = len(token)
    if n == 1 and not token.isalnum():
        return ["sign=" + token if token.isascii() else "sign"]
    digits = sum(map(str.isdigit, token))
    if not digits:
        return ["word", f"length={min(n, 32) // 8}", *(["keyword"] if KEYWORD.search(token) else []),
                *(["upper"] if token.isupper() and n > 3 else [])]
    letters = sum(map(str.isalpha, token))
    turns = sum([a.isdigit() != b.isdigit() for a, b in zip(token, token[1:])])
    case = "none" if not letters else "lower" if token.islower() else "upper" if token.isupper() else "both"
    return [f"length={min(n, 48) // 8}", f"digits={4 * digits // n}", f"turns={min(turns, 12) // 3}", f"case={case}",
            f"letters={4 * letters // n}", f"long+mixed={n >= 16 and turns >= 4 and letters >= 4}",
            "dots" if "." in token else "no-dots", *(["keyword"] if KEYWORD.search(token) else [])]


def file_features(text: str) -> list[str]:
    """Features of the file a token is in."""
    return [f"file-assigns={'=' in text}", f"file-quotes={chr(34) in text}", f"file-size={min(len(text), 9999).bit_length() // 3}"]


@functools.lru_cache(maxsize=200_000)
def neighbour(token: str) -> str:
    """A token as seen from its neighbours: signs and key words by name, else its kind."""
    if len(token) == 1 and not token.isalnum():
        return "sign=" + token if token.isascii() else "sign"
    if KEYWORD.search(token):
        return "keyword"
    return "number" if any(map(str.isdigit, token)) else "word"


def window_features(tokens: list[str], at: int, files: list[str]) -> list[str]:
    around = [f"{k}:{neighbour(tokens[at + k]) if 0 <= at + k < len(tokens) else 'edge'}" for k in (-2, -1, 1, 2)]
    return shape_features(tokens[at]) + around + files


def training_windows(text: str) -> list[tuple[list[list[str]], list[int]]]:
    """(features of each token, tag of each token) of windows around secrets
    and around other tokens with digits or key words."""
    spans = [(m.start(), m.end(), m.group()) for m in TOKEN.finditer(text)]
    marks = [w for w, (_, _, t) in enumerate(spans) if neighbour(t) in ("keyword", "number")]
    if not marks:
        marks = [len(spans) // 2] if spans else []
    tokens, tags = [t for _, _, t in spans], [O] * len(spans)
    secrets, s = base_spans(text), 0
    covered: list[list[int]] = []
    for start, end, _ in secrets:
        if covered and start < covered[-1][1]:
            covered[-1][1] = max(covered[-1][1], end)
        else:
            covered.append([start, end])
    for w, (a, b, _) in enumerate(spans):
        while s < len(covered) and covered[s][1] <= a:
            s += 1
        if s < len(covered) and a < covered[s][1] and b > covered[s][0]:
            tags[w] = I if w and tags[w - 1] != O and spans[w - 1][1] > covered[s][0] else B
    files, out, done = file_features(text), [], -1
    for w in marks:
        if w <= done:
            continue
        lo, hi = max(0, w - WINDOW), min(len(tokens), w + WINDOW + 1)
        out.append(([window_features(tokens, x, files) for x in range(lo, hi)], tags[lo:hi]))
        done = hi - 1
    return out


def learn(windows: list[tuple[list[list[str]], list[int]]], steps: int = 80, rate: float = 0.3,
          l2: float = 1e-4) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Weights by feature (one per tag) and the 3 x 3 transitions, by gradient
    ascent (per-coordinate rates) on the conditional log-likelihood."""
    names = {f: i for i, f in enumerate(sorted({f for feats, _ in windows for x in feats for f in x}))}
    most, width = max(len(t) for _, t in windows), max(len(x) for feats, _ in windows for x in feats)
    n = len(windows)
    at = np.full((n, most, width), len(names), np.int32)
    gold, real = np.full((n, most), O, np.int8), np.zeros((n, most), bool)
    for w, (feats, tags) in enumerate(windows):
        for k, x in enumerate(feats):
            at[w, k, :len(x)] = [names[f] for f in x]
        gold[w, :len(tags)], real[w, :len(tags)] = tags, True
    unary, trans = np.zeros((len(names) + 1, 3)), np.zeros((3, 3))
    sums = [np.full_like(unary, 1e-6), np.full_like(trans, 1e-6)]
    one_hot = np.eye(3)[gold] * real[..., None]
    pair_real = real[:, 1:] & real[:, :-1]
    gold_pairs = np.einsum("nti,ntj,nt->ij", one_hot[:, :-1], one_hot[:, 1:], pair_real.astype(float))
    for _ in range(steps):
        score = unary[at].sum(2) * real[..., None]
        alpha, beta = np.zeros_like(score), np.zeros_like(score)
        alpha[:, 0] = score[:, 0]
        for t in range(1, most):
            step = np.logaddexp.reduce(alpha[:, t - 1, :, None] + trans, axis=1) + score[:, t]
            alpha[:, t] = np.where(real[:, t, None], step, alpha[:, t - 1])
        for t in range(most - 2, -1, -1):
            step = np.logaddexp.reduce(trans + (score[:, t + 1] + beta[:, t + 1])[:, None, :], axis=2)
            beta[:, t] = np.where(real[:, t + 1, None], step, 0.0)
        log_z = np.logaddexp.reduce(alpha[:, -1], axis=1)
        p = np.exp(alpha + beta - log_z[:, None, None]) * real[..., None]
        pairs = np.exp(alpha[:, :-1, :, None] + trans + (score[:, 1:] + beta[:, 1:])[:, :, None, :] - log_z[:, None, None, None])
        grad_u = -l2 * n * unary
        for tag in range(3):
            miss = np.repeat((one_hot - p)[..., tag].ravel(), width)
            grad_u[:, tag] += np.bincount(at.ravel(), miss, len(unary))
        grad_t = gold_pairs - (pairs * pair_real[..., None, None]).sum((0, 1)) - l2 * n * trans
        for value, grad, total in ((unary, grad_u, sums[0]), (trans, grad_t, sums[1])):
            total += grad * grad
            value += rate * grad / np.sqrt(total)
        unary[-1] = 0
    return {f: unary[i] for f, i in names.items()}, trans


class TokenTable(dict):
    """Token -> row of ``rows``: its three scores by shape and its kind as a neighbour."""

    def __init__(self, describe):
        super().__init__()
        self.describe, self.rows = describe, np.zeros((1024, 4))

    def __missing__(self, token: str) -> int:
        at = len(self)
        if at == len(self.rows):
            self.rows = np.vstack([self.rows, np.zeros_like(self.rows)])
        self.rows[at] = self.describe(token)
        self[token] = at
        return at


class Tagger:
    """Decodes texts; the scores of tokens are kept in a table of bounded size."""

    def __init__(self, unary: dict[str, np.ndarray], trans: np.ndarray):
        self.unary, self.trans = unary, trans
        zero = np.zeros(3)
        self.get = lambda f: unary.get(f, zero)
        kinds = sorted({f.split(":", 1)[1] for f in unary if f[:2] in ("-2", "-1", "1:", "2:")}
                       | {"word", "number", "keyword", "sign", "edge"})
        self.kinds = {k: i for i, k in enumerate(kinds)}
        self.around = {k: np.array([self.get(f"{k}:{name}") for name in kinds]) for k in (-2, -1, 1, 2)}
        # what changing one token's tag can win back over both transitions
        self.win_back = 2 * float(trans.max() - trans.min())
        self.table = TokenTable(self.describe)

    def describe(self, token: str) -> list[float]:
        own = sum((self.get(f) for f in shape_features(token)), np.zeros(3))
        return [*own, self.kinds.get(neighbour(token), self.kinds["word"])]

    def spans(self, text: str) -> list[tuple[int, int]]:
        """Spans of the best path that begin with B and hold a token with both
        letters and digits."""
        tokens = TOKEN.findall(text)
        if not tokens:
            return []
        if len(self.table) > TABLE_ENTRIES:
            self.table.clear()
        at = list(map(self.table.__getitem__, tokens))
        rows = self.table.rows[at]
        kind = rows[:, 3].astype(np.int64)
        score = rows[:, :3] + sum((self.get(f) for f in file_features(text)), np.zeros(3))
        edge = self.kinds["edge"]
        for k, table in self.around.items():
            near = np.full(len(kind), edge)
            if abs(k) < len(kind):
                if k < 0:
                    near[-k:] = kind[:k]
                else:
                    near[:-k] = kind[k:]
            score += table[near]
        open_ = np.flatnonzero(score[:, O] - score[:, :2].max(1) <= self.win_back)
        if not len(open_):
            return []
        tags = np.full(len(tokens), O, np.int8)
        for run in np.split(open_, np.flatnonzero(np.diff(open_) > 1) + 1):
            tags[run] = self.viterbi(score[run], run[0] > 0, run[-1] < len(tokens) - 1)
        if (tags == O).all():
            return []
        places = [m.span() for m in TOKEN.finditer(text)]
        out, w = [], 0
        while w < len(tokens):
            if tags[w] != B:
                w += 1
                continue
            end = w + 1
            while end < len(tokens) and tags[end] == I:
                end += 1
            held = [t for t in tokens[w:end] if len(t) >= 8 and any(map(str.isdigit, t)) and any(map(str.isalpha, t))]
            if held:
                out.append((places[w][0], places[end - 1][1]))
            w = end
        return out

    def viterbi(self, score: np.ndarray, after_o: bool, before_o: bool) -> np.ndarray:
        trans = self.trans
        best = score[0] + (trans[O] if after_o else 0)
        back = np.zeros((len(score), 3), np.int8)
        for t in range(1, len(score)):
            step = best[:, None] + trans
            back[t] = step.argmax(0)
            best = step.max(0) + score[t]
        if before_o:
            best = best + trans[:, O]
        tags = np.zeros(len(score), np.int8)
        tags[-1] = best.argmax()
        for t in range(len(score) - 1, 0, -1):
            tags[t - 1] = back[t][tags[t]]
        return tags


def train(docs: DataFrame, text_col: str = "text", max_docs: int = 10_000, max_windows: int = 3_000) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Weights learned from at most about ``max_docs`` distinct texts and
    ``max_windows`` distinct windows of them, half of these with a secret if
    there are that many: copies change nothing.  Without any window: no
    weights, so nothing is tagged."""
    spark = docs.sparkSession
    ship(spark)
    texts = docs.select(whole_text(text_col).alias("text"))
    # counted by hash, so that only the texts of the sample are shuffled
    total = texts.select(F.xxhash64("text")).distinct().count()
    if total > max_docs:
        texts = texts.where(F.pmod(F.xxhash64("text", F.lit(9)), F.lit(1 << 20)) < int((1 << 20) * max_docs / total))
    texts = texts.distinct()

    def cut(batches: Iterator[pd.DataFrame]):
        claim("secrets", neighbour.cache_clear)
        for pdf in batches:
            rows = [w for t in pdf["text"] for w in training_windows(t)]
            yield pd.DataFrame({"secret": [any(t != O for t in tags) for _, tags in rows],
                                "feats": ["\n".join("\t".join(x) for x in feats) for feats, _ in rows],
                                "tags": ["".join(map(str, tags)) for _, tags in rows]})

    windows = texts.mapInPandas(cut, "secret boolean, feats string, tags string").distinct()
    # a bounded pick per class: the smallest hashes
    picked = staged(windows.withColumn("pick", F.xxhash64("feats", "tags")), "crf-windows")
    half = max_windows // 2
    bounded = picked.where("secret").orderBy("pick").limit(half).unionByName(picked.where("NOT secret").orderBy("pick").limit(half))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["pick", "tags"], kind="stable")
        rows = [([x.split("\t") for x in f.split("\n")], [int(c) for c in t]) for f, t in zip(pdf["feats"], pdf["tags"])]
        unary, trans = learn(rows)
        names = [*unary, *[f"trans{i}" for i in range(3)]]
        values = np.vstack([*unary.values(), trans])
        return pd.DataFrame({"name": names, "b": values[:, B], "i": values[:, I], "o": values[:, O]})

    got = {r["name"]: np.array([r["b"], r["i"], r["o"]]) for r in
           bounded.withColumn("all", F.lit("all")).groupBy("all").applyInPandas(fit, "name string, b double, i double, o double").collect()}
    if not got:
        return {}, np.zeros((3, 3))
    trans = np.vstack([got.pop(f"trans{i}") for i in range(3)])
    return got, trans


def find_secrets(df: DataFrame, model: tuple[dict[str, np.ndarray], np.ndarray] | None = None, text_col: str = "text",
                 out_col: str = "secrets") -> DataFrame:
    """Add (or replace) ``secrets``: array of (start, end, kind) of every whole text, by
    start, then kind (assign, access, hex, crf); code points, end exclusive.

    Tagged spans that touch a pattern's span are left out (the pattern's
    stay).  ``model`` None: learned from ``df`` itself.  Null and empty texts
    have no spans; rows are independent, repeated rows stay repeated, an empty
    table gives no rows; other columns are kept as they are.
    """
    spark = df.sparkSession
    ship(spark)
    unary, trans = train(df, text_col) if model is None else model
    shared = spark.sparkContext.broadcast((unary, trans))
    kind = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()),
                                     T.StructField("kind", T.StringType())]))

    def start():
        claim("secrets", neighbour.cache_clear)
        tagger = Tagger(*shared.value)

        def scan(text: str) -> list[dict]:
            found = base_spans(text)
            if tagger.unary:
                extra = [(a, b, "crf") for a, b in tagger.spans(text) if not any(a < e and s < b for s, e, _ in found)]
                found = sorted(found + extra, key=lambda s: (s[0], KINDS.index(s[2])))
            return [{"start": a, "end": b, "kind": k} for a, b, k in found]

        return lambda texts: [[scan(t) for t in texts]]

    return map_texts(df.drop(out_col), text_col, [T.StructField(out_col, kind)], start, keep_text=True)


def mask(text_col: str = "text", spans_col: str = "secrets", by: str = "[SECRET]"):
    """The text with every span replaced; overlapping spans become one mark."""
    step = (f"aggregate({spans_col}, named_struct('at', 1, 'out', ''), (a, s) -> "
            f"if(s.end < a.at, a, named_struct('at', s.end + 1, 'out', "
            f"if(s.start + 1 < a.at, a.out, concat(a.out, substring({text_col}, a.at, s.start + 1 - a.at), '{by}')))), "
            f"a -> concat(a.out, substring({text_col}, a.at)))")
    return F.when(F.size(spans_col) > 0, F.expr(step)).otherwise(F.col(text_col))
