"""Personal data: fixed patterns, and a skip-chain conditional random field that makes a document's labels agree.

The field's nodes are a text's tokens (runs without white space) that hold a digit or an ``@``; all other tokens are outside every entity by definition, so the
field falls apart at them and they need no nodes. A node's own potential comes from hashed features of its form and context: its letters and digits as classes, how many
digits, signs, and the words before and behind, of which up to 24 characters count. A chain edge joins neighbouring tokens. Skip edges join tokens however far apart: each token
to the first one of the same letters and digits, and to the first one that begins or ends with the same eight (a misspelt or shortened repeat). Hubs keep all repeats
within two edges, so messages reach them in few rounds. Loopy belief propagation passes messages along all edges, and so an entity recognised in one place
also counts in the others. Nodes that are sure of a label, outside the fixed patterns' spans, become further spans.

The field learns from the patterns on a bounded sample, but isn't taught to repeat them. It never sees the tests that a match must pass (check digits,
ranges, counts), only form and context. What the patterns leave out is a negative only if nothing of its form is ever an entity; otherwise it is
unlabelled and takes no part in the fit, as are its links. And of every second node the form is hidden, so that context and edges learn to speak for it.
The weights maximise the pseudo-likelihood.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenderlake.llm.common import SAMPLE_BYTES, arrow_fields, map_rows, text_of, within_bytes
from tenderlake.sources.tables import discard, load_table

Span = tuple[str, int, int]
KINDS = ("email", "ip", "card", "phone")
LABELS = ("O", *KINDS)
BUCKETS = 1 << 13

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: Matches begin where a run of digits begins; the look-behind says so, and keeps long runs from being tried at every digit.
IP = re.compile(r"(?<![0-9])([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
DIGITS = re.compile(r"[0-9]+")
LETTERS = re.compile(r"[^\W\d_]+")
SIGNS = re.compile(r"[\W_]+")
TRAIL = re.compile(r"[\W_]+\Z")
TOKEN = re.compile(r"(?<!\S)[^\s0-9@]*[0-9@]\S*")
WORD_BEFORE = re.compile(r"(\S{1,24})\s{1,4}\Z")
WORD_AFTER = re.compile(r"\s{1,4}(\S{1,24})")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def emails(text: str) -> list[Span]:
    """From each ``@`` to both sides, in linear time: the local part is the run of its characters before, back to the last match at most."""
    out, end = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            end = m.end()
            out.append(("email", start, end))
        at = text.find("@", max(at + 1, end))
    return out


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns by kind, then place: leftmost, not overlapping within a kind; matches that fail a test are dropped."""
    out = emails(text)
    if DIGIT.search(text):
        out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(len(p := x.lstrip("0")) < 4 and int(p or "0") <= 255 for x in m.groups())]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 13:
                digits = m[0].replace(" ", "").replace("-", "")
                if 13 <= len(digits) <= 19 and luhn(digits):
                    out.append(("card", m.start(), m.end()))
        if "+" in text:
            out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= len(DIGIT.findall(m[0])) <= 15]
    return out


def form(token: str) -> str:
    """Letters as ``a``, digits as ``9``, runs of one kind as one, signs as they are."""
    return DIGITS.sub("9", LETTERS.sub("a", token))


def hashed(name: str) -> int:
    return zlib.crc32(name.encode("utf-8", "surrogatepass")) % BUCKETS


#: Kinds of edges. A chain edge knows which end comes first; the others are symmetrical.
CHAIN, SAME, SIMILAR = range(3)
#: Names of features that tell a node's form; the rest tell its context.
FORM_FEATURES = 5


@dataclass
class Graph:
    """Tokens (start, end), their forms and features, and edges (earlier, later, kind)."""

    tokens: list[tuple[int, int]]
    forms: list[str]
    features: list[list[int]]
    edges: list[tuple[int, int, int]]


def graph_of(text: str) -> Graph:
    tokens = [m.span() for m in TOKEN.finditer(text)]
    features, edges = [], []
    first: dict[str, int] = {}
    # Signs behind a token are the sentence's, not the token's.
    forms = [form(TRAIL.sub("", text[s:e]) or text[s:e]) for s, e in tokens]
    for i, (s, e) in enumerate(tokens):
        token = text[s:e]
        near = i > 0 and s - tokens[i - 1][1] <= 2
        soon = i + 1 < len(tokens) and tokens[i + 1][0] - e <= 2
        before = WORD_BEFORE.search(text, max(0, s - 30), s)
        after = WORD_AFTER.match(text, e)
        names = [
            f"form {forms[i]}",
            f"digits {len(DIGIT.findall(token))}",
            f"first {form(token[0])}",
            f"at {token.count('@')} {'.' in token.partition('@')[2]}",
            f"dots {min(token.count('.'), 5)}",
            "bias",
            f"before {forms[i - 1] if near else before[1].lower() if before else ''}",
            f"after {forms[i + 1] if soon else after[1].lower() if after else ''}",
        ]
        features.append([hashed(x) for x in names])
        if near:
            edges.append((i - 1, i, CHAIN))
        key = SIGNS.sub("", token).lower()
        if len(key) >= 4:
            same = first.setdefault(f"= {key}", i)
            if same < i:
                edges.append((same, i, SAME))
            elif len(key) > 8:
                hubs = {first.setdefault(f"< {key[:8]}", i), first.setdefault(f"> {key[-8:]}", i)}
                edges += [(hub, i, SIMILAR) for hub in sorted(hubs) if hub < i]
            elif len(key) == 8:  # all of a longer one's beginning or end
                hubs = {first.get(f"< {key}", i), first.get(f"> {key}", i)}
                edges += [(hub, i, SIMILAR) for hub in sorted(hubs) if hub < i]
    return Graph(tokens, forms, features, edges)


def labels_of(graph: Graph, spans: list[Span]) -> list[int]:
    """For each token the first kind, in their order, of a span that overlaps it."""
    out = [0] * len(graph.tokens)
    starts = [s for s, _ in graph.tokens]
    for kind, start, end in reversed(spans):
        i = max(0, int(np.searchsorted(starts, start, "right")) - 1)
        while i < len(out) and graph.tokens[i][0] < end:
            if graph.tokens[i][1] > start:
                out[i] = LABELS.index(kind)
            i += 1
    return out


@dataclass
class FieldModel:
    """Potentials in logarithms: features by label, and for each kind of edge the earlier end's label by the later one's."""

    unary: np.ndarray
    pairs: np.ndarray


def untrained() -> FieldModel:
    """Knows of no entity: every token is surely outside."""
    unary = np.zeros((BUCKETS, len(LABELS)))
    unary[hashed("bias"), 0] = 20.0
    return FieldModel(unary, np.zeros((3, len(LABELS), len(LABELS))))


def symmetrical(pairs: np.ndarray) -> np.ndarray:
    pairs[1:] = (pairs[1:] + pairs[1:].transpose(0, 2, 1)) / 2
    return pairs


def fit(features: np.ndarray, labels: np.ndarray, edges: np.ndarray, steps: int = 150, rate: float = 0.5, penalty: float = 1e-4) -> FieldModel:
    """Pseudo-likelihood by adaptive gradient steps: each node's label given its features and its neighbours' labels. A negative label is unknown.

    Every second node has its features of form hidden (their weights count as none).
    """
    known = labels >= 0
    if not known.any():
        return untrained()
    n, k = known.sum(), len(LABELS)
    model = FieldModel(np.zeros((BUCKETS, k)), np.zeros((3, k, k)))
    squares = [np.full_like(model.unary, 1e-8), np.full_like(model.pairs, 1e-8)]
    truth = np.eye(k)[np.maximum(labels, 0)]
    shown = np.ones(features.shape, bool)
    shown[::2, :FORM_FEATURES] = False
    edges = edges[known[edges[:, 0]] & known[edges[:, 1]]]
    a, b, kind = edges.T
    for _ in range(steps):
        logits = (model.unary[features] * shown[:, :, None]).sum(1)
        np.add.at(logits, b, model.pairs[kind, labels[a]])
        np.add.at(logits, a, model.pairs[kind, :, labels[b]])
        logits -= logits.max(1, keepdims=True)
        p = np.exp(logits)
        error = (p / p.sum(1, keepdims=True) - truth) * known[:, None] / n
        unary = np.stack([np.bincount(features[shown], np.broadcast_to(error[:, j, None], features.shape)[shown], BUCKETS) for j in range(k)], 1)
        pairs = np.zeros_like(model.pairs)
        np.add.at(pairs, (kind, labels[a]), error[b])
        np.add.at(pairs.transpose(0, 2, 1), (kind, labels[b]), error[a])
        for weights, grad, square in zip((model.unary, model.pairs), (unary + penalty * model.unary, symmetrical(pairs) + penalty * model.pairs), squares, strict=True):
            square += grad**2
            weights -= rate * grad / np.sqrt(square)
    return model


def marginals(model: FieldModel, features: np.ndarray, edges: np.ndarray, text_of_node: np.ndarray | None = None, rounds: int = 50, damping: float = 0.3, enough: float = 1e-4, block: int = 1 << 16) -> np.ndarray:
    """Loopy belief propagation: each node's probabilities of the labels. Exact where the edges have no loop.

    Texts (``text_of_node``) that stand side by side end by themselves, each when its own messages change by less than ``enough``, so what stands beside a text
    doesn't matter. Messages are renewed ``block`` edges at a time, which bounds the room that a very long text takes.
    """
    own = model.unary[features].sum(1)
    k = own.shape[1]
    edges = np.asarray(edges, int).reshape(-1, 3)
    texts = np.zeros(len(own), int) if text_of_node is None else text_of_node
    source = np.concatenate([edges[:, 0], edges[:, 1]])
    target = np.concatenate([edges[:, 1], edges[:, 0]])
    both_ways = np.stack([model.pairs, model.pairs.transpose(0, 2, 1)])  # by direction, kind, source label, target label
    m = len(edges)
    messages = np.zeros((2 * m, k))
    going = np.arange(2 * m)

    def gather() -> np.ndarray:
        return own + np.stack([np.bincount(target, messages[:, j], len(own)) for j in range(k)], 1) if m else own

    for _ in range(rounds):
        if not len(going):
            break
        belief = gather()
        renewed = np.empty((len(going), k))
        for at in range(0, len(going), block):
            e = going[at : at + block]
            x = (belief[source[e]] - messages[(e + m) % (2 * m)])[:, :, None] + both_ways[e // m, edges[e % m, 2]]
            top = x.max(1, keepdims=True)
            x = np.log(np.exp(x - top).sum(1)) + top[:, 0]
            renewed[at : at + block] = x - x.max(1, keepdims=True)
        change = np.zeros(int(texts.max()) + 1)
        np.maximum.at(change, texts[source[going]], np.abs(renewed - messages[going]).max(1))
        messages[going] = damping * messages[going] + (1 - damping) * renewed
        going = going[change[texts[source[going]]] >= enough]
    belief = gather()
    p = np.exp(belief - belief.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def order(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda x: (KINDS.index(x[0]), x[1], x[2]))


def vouched(model: FieldModel, features: list[int], label: int) -> bool:
    """Whether what stands around a token speaks for the label, whatever the token's form: the context's features alone give it half of the weight at least."""
    score = model.unary[features[FORM_FEATURES:]].sum(0)
    weight = np.exp(score - score.max())
    return bool(weight[label] >= 0.5 * weight.sum())


def find_spans(texts: list[str], model: FieldModel, sure: float = 0.9) -> list[tuple[list[Span], list[Span]]]:
    """The base spans and all spans of each text. The texts' fields are put side by side and pass their messages at once.

    A token is not added for its form alone, which the patterns have judged already (a number as long as a card's with a wrong check digit is none): its context must speak for the label too, or a token
    that a pattern has found must be its repeat or nearly so.
    """
    bases = [base_spans(t) for t in texts]
    graphs = [graph_of(t) for t in texts]
    at = np.cumsum([0, *(len(g.tokens) for g in graphs)])
    if not at[-1]:
        return [(b, b) for b in bases]
    edges = np.array([(a + o, b + o, kind) for o, g in zip(at.tolist(), graphs, strict=False) for a, b, kind in g.edges], int).reshape(-1, 3)
    owner = np.repeat(np.arange(len(graphs)), np.diff(at))
    # Rounded: sums of the same numbers in another order may differ in their last digits.
    p = marginals(model, np.array([f for g in graphs for f in g.features]), edges, owner).round(6)
    best, surely = p.argmax(1), p.max(1) >= sure
    out = []
    for text, base, g, o in zip(texts, bases, graphs, at.tolist(), strict=False):
        labelled = [LABELS[best[o + i]] if surely[o + i] else "O" for i in range(len(g.tokens))]
        covered = labels_of(g, base)
        linked = {(a, b) for a, b, kind in g.edges if kind == CHAIN}
        alike: dict[int, list[tuple[int, int, int]]] = {}
        for edge in g.edges:
            if edge[2] != CHAIN:
                alike.setdefault(edge[0], []).append(edge)
                alike.setdefault(edge[1], []).append(edge)
        extra: list[Span] = []
        for i, (s, e) in enumerate(g.tokens):
            if labelled[i] == "O" or covered[i]:
                continue
            while e - s > 1 and text[e - 1] in ".,;:!?)]}\"'":
                e -= 1
            label = LABELS.index(labelled[i])
            if not vouched(model, g.features[i], label) and not any(covered[b if a == i else a] == label for a, b, _ in alike.get(i, ())):
                continue
            # Cards and phones may be written in groups; whatever is long enough by itself is one by itself.
            group = labelled[i] in ("card", "phone") and len(DIGIT.findall(text[s:e])) < 13
            if group and extra and extra[-1][0] == labelled[i] and (i - 1, i) in linked and extra[-1][2] >= g.tokens[i - 1][1] - 1 and not covered[i - 1]:
                extra[-1] = (labelled[i], extra[-1][1], e)
            else:
                extra.append((labelled[i], s, e))
        out.append((base, order(base + extra)))
    return out


def train(docs: DataFrame, sample: int = 2000, id_col: str = "doc_id", text_col: str = "text", sample_bytes: int = SAMPLE_BYTES) -> FieldModel:
    """Fit on at most ``sample`` documents and ``sample_bytes`` of their texts, of those that hold a digit or an ``@``: those whose ids hash lowest, one row for each id. Only hashed features, forms, labels and edges come to the driver."""
    some = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("chosen_id"), text_of(text_col).alias("body")).where(F.col("chosen_id").isNotNull() & F.col("body").rlike("[0-9@]"))
    chosen = some.select("chosen_id").distinct().orderBy(F.xxhash64("chosen_id"), "chosen_id").limit(sample)
    rows = within_bytes(some.join(F.broadcast(chosen), "chosen_id").groupBy("chosen_id").agg(F.max("body").alias("body")), "chosen_id", sample_bytes)
    numbers = pa.list_(pa.int32())
    schema = arrow_fields(chosen_id="long", forms=numbers, features=numbers, labels=numbers, edges=numbers)

    def make():
        def work(ids: list, texts: list[str]) -> list[list]:
            graphs = [graph_of(t) for t in texts]
            flat = lambda rows: [x for row in rows for x in row]
            forms = [[zlib.crc32(f.encode("utf-8", "surrogatepass")) >> 1 for f in g.forms] for g in graphs]
            return [ids, forms, [flat(g.features) for g in graphs], [labels_of(g, base_spans(t)) for g, t in zip(graphs, texts, strict=True)], [flat(g.edges) for g in graphs]]

        return work

    found = map_rows(rows, schema, make).toArrow().sort_by("chosen_id").combine_chunks()
    discard(rows)
    cut = lambda name: found[name].combine_chunks()
    flat = lambda name: cut(name).flatten().to_numpy().astype(int)
    count = lambda name: cut(name).value_lengths().to_numpy(zero_copy_only=False)
    labels, forms = flat("labels"), flat("forms")
    if not len(labels):
        return untrained()
    # Edges number the tokens of their document; here they number those of all.
    first = np.cumsum([0, *count("labels")])[:-1]
    edges = flat("edges").reshape(-1, 3) + np.repeat(first, count("edges") // 3)[:, None] * [1, 1, 0]
    labels[(labels == 0) & np.isin(forms, forms[labels > 0])] = -1
    return fit(flat("features").reshape(len(labels), -1), labels, edges)


SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("text", pa.string()), ("base", pa.bool_())])
SCHEMA = arrow_fields(doc_id="long", spans=pa.list_(SPAN))


def find_personal_data(df: DataFrame, model: FieldModel, id_col: str = "doc_id", text_col: str = "text", sure: float = 0.9) -> DataFrame:
    """``doc_id`` and ``spans`` (kind, start, end in code points, text, whether a fixed pattern gave it) for each row of ``df``.

    Whole texts are read. A null text counts as empty and has no spans; a null id stays null; equal texts get equal spans; other columns aren't read, whatever
    their names; an empty table gives an empty result.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def make():
        def work(ids: list, texts: list[str]) -> list[list]:
            out = []
            for text, (base, spans) in zip(texts, find_spans(texts, shared.value, sure), strict=True):
                held = set(base)
                out.append([{"kind": k, "start": s, "end": e, "text": text[s:e], "base": (k, s, e) in held} for k, s, e in spans])
            return [ids, out]

        return work

    return map_rows(df.select(F.col(f"`{id_col}`").cast("bigint"), text_of(text_col)), SCHEMA, make)


def op2_pii_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load_table(spark, sf_dir, "documents")
    found = find_personal_data(docs, train(docs))
    n = lambda kind: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("bigint").alias(f"n_{kind}")
    put = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select("doc_id", *(n(k) for k in KINDS), F.sha2(put(F.filter("spans", lambda s: s["base"])), 256).alias("base_sha256"), put(F.col("spans")).alias("spans"))
