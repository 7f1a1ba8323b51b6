"""Personal data by patterns and a skip-chain conditional random field.

Patterns give the base spans. The random field adds what the patterns miss but the document itself gives
away: its nodes are the runs of identifier characters that hold a digit, @ or +; neighbours in the text are
linked in a chain, and distant tokens that repeat or resemble each other (the same letters and digits, the
same last digits of a long number, the same name before an @, a masked number and the same last digits) are
linked by skip edges that share a potential, one for long likenesses and one for short ones. Tokens under base
spans are known; loopy sum-product message passing gives the others their marginals. Tokens at or above LEAST
become spans: of the base kinds where their component holds a known token of that kind, and of the further
kind secret (keys and passwords that the text assigns, and their repeats elsewhere). Adjacent tokens of one
kind are one span.

It is trained in numpy by pseudo-likelihood on a bounded sample of documents. Labels are the base spans and
the values of assignments to a name of ASSIGNED; other forms of these values (a card's last digits behind a
mask, a phone's bare digits, a key without its name) are appended to half of them in the training texts,
and tokens with a long likeness to a labelled one carry its label, so that the field learns to follow skip
edges where a token's own looks say nothing.

How it scales: one pass without a shuffle; documents without a digit, @ or + end at one scan. Patterns, tokens
and links take linear time: a token is linked to the next of its like only.

Defined results: null text is empty. Offsets are code points, end exclusive. A failing match is dropped
and not retried. Spans are ordered by start, then kind; equal spans of different kinds stay. Added spans
never overlap base ones. Repeated rows stay repeated; extra columns are ignored. An empty table gives no row,
and without a document to learn from the field follows skip edges by its prior alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanloom.llm.cluster import mapped, only
from loanloom.llm.textbatch import pieces

KINDS = ("email", "ip", "card", "phone")
#: What the field can add: the base kinds and secrets.
ALL_KINDS = (*KINDS, "secret")
SECRET = len(KINDS)
#: Bound of the training sample: documents with a candidate token, each with its whole text.
SAMPLE = 600
LEAST = 0.8
#: Rounds of message passing; stops sooner when messages settle.
ROUNDS = 30
#: Digits at the end of a number by which numbers resemble each other.
LAST_DIGITS = 7

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")  # a failing run of digits fails from any of its places
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_ANY = re.compile(r"[0-9@+]")
_TOKEN = re.compile(r"[A-Za-z0-9@+._%*-]+")
_EDGE = "._%*-"
#: Names whose assigned values are secrets.
ASSIGNED = ("token", "secret", "password", "passwd", "pwd", "api key", "api_key", "apikey", "access key", "access_key")
_CUE = re.compile(rf"(?i)(?:{'|'.join(ASSIGNED)})[\"']?\s{{0,3}}[=:]\s{{0,3}}[\"']?$")
_ASSIGNMENT = re.compile(rf"(?i)(?:{'|'.join(ASSIGNED)})[\"']?\s{{0,3}}[=:]")
#: The least characters of a secret.
SECRET_CHARS = 8

Span = tuple[int, int, int]  # start, end, number of the kind


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    found: list[Span] = []
    low, at = 0, text.find("@")
    while at >= 0:
        run = text[low:at]
        start = low + len(run.rstrip(_LOCAL))
        low = at + 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            found.append((start, m.end(), 0))
            low = m.end()
        at = text.find("@", low)
    for m in _IP.finditer(text):
        if all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255 for part in m.group().split(".")):
            found.append((m.start(), m.end(), 1))
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), m.end(), 2))
    for m in _PHONE.finditer(text):
        if 9 <= sum(c in "0123456789" for c in m.group()) <= 15:
            found.append((m.start(), m.end(), 3))
    return sorted(found, key=lambda s: (s[0], s[2], s[1]))


N_FEATURES = 19
_CUED = 16  # the feature of an assigned value


def features(token: str, cue: bool, adjacent_before: bool, adjacent_after: bool) -> list[float]:
    """What a token looks like, without the patterns themselves."""
    digits = sum(map(token.count, "0123456789"))
    letters = len(token) - digits - sum(map(token.count, "@+._%*-"))
    return [1, "@" in token, "." in token.strip("."), token.count(".") >= 3, token.startswith("+"), "-" in token, "*" in token, digits == 0, 1 <= digits <= 4, 5 <= digits <= 11, 12 <= digits <= 19, letters == 0, letters >= digits > 0, digits > 0.8 * len(token), adjacent_before, adjacent_after, cue, digits > 0 and letters > 0 and digits + letters >= 16, digits + letters >= SECRET_CHARS]


_NO_CORE = str.maketrans("", "", "@+._%*-")


def likeness(token: str) -> list[tuple[str, bool]]:
    """Keys under which a token is linked to others, and whether each is a long likeness."""
    core = token.lower().translate(_NO_CORE)
    digits = "".join(filter(str.isdigit, core))
    keys = [(core, len(core) >= LAST_DIGITS)] if len(core) > 2 else []
    if len(digits) >= LAST_DIGITS:
        keys.append(("#" + digits[-LAST_DIGITS:], True))
        keys.append(("~" + digits[-4:], True))
    elif "*" in token and len(digits) == 4 and token.endswith(digits):
        keys.append(("~" + digits, True))
    if "@" in token:
        keys.append((token.lower().split("@")[0].translate(_NO_CORE), True))
    return keys


@dataclass
class Graph:
    spans: list[tuple[int, int]]
    x: np.ndarray
    known: np.ndarray  # label of tokens under given spans (kind + 1), else -1
    chain: np.ndarray
    skip: np.ndarray
    long: np.ndarray  # whether a skip edge is a long likeness


def graph(text: str, given: list[Span]) -> Graph:
    """Candidate tokens, their features and links; given spans, sorted, are what is known."""
    spans, tokens = [], []
    for m in _TOKEN.finditer(text):
        token = m.group()
        if not _ANY.search(token):
            continue
        stripped = token.lstrip("._%-").rstrip("._%-")
        if stripped:
            left = token.find(stripped)
            spans.append((m.start() + left, m.start() + left + len(stripped)))
            tokens.append(stripped)
    near = [bool(k) and spans[k][0] - spans[k - 1][1] <= 3 and not text[spans[k - 1][1] : spans[k][0]].strip(" \t()-./") for k in range(len(spans))]
    cue = [len(t) >= SECRET_CHARS and bool(_CUE.search(text, max(0, a - 24), a)) for t, (a, _) in zip(tokens, spans, strict=True)]
    x = np.array([features(t, cue[k], near[k], k + 1 < len(near) and near[k + 1]) for k, t in enumerate(tokens)], float).reshape(-1, N_FEATURES)
    known = np.full(len(spans), -1)
    of_span: dict[int, list[int]] = {}
    at = 0
    for k, (start, end) in enumerate(spans):
        while at < len(given) and given[at][1] <= start:
            at += 1
        for j in range(at, min(at + 4, len(given))):
            if given[j][0] < end and given[j][1] > start:
                known[k] = given[j][2] + 1
                of_span.setdefault(j, []).append(k)
                break
    keys = [likeness(t) for t in tokens]
    for j, members in of_span.items():  # a number in several tokens resembles by all its digits
        if len(members) > 1:
            keys[members[-1]].extend(likeness(text[given[j][0] : given[j][1]].translate(_NO_SPACE)))
    chain = [(k - 1, k) for k in range(1, len(spans)) if near[k]]
    last: dict[str, tuple[int, bool]] = {}
    skip: dict[tuple[int, int], bool] = {}
    for k, own in enumerate(keys):
        for key, is_long in own:
            before, was_long = last.get(key, (k, False))
            if before != k:
                skip[before, k] = skip.get((before, k), False) or is_long or was_long
            last[key] = k, is_long
    for edge in chain:
        skip.pop(edge, None)
    edges = sorted(skip)
    return Graph(spans, x, known, np.array(chain, int).reshape(-1, 2), np.array(edges, int).reshape(-1, 2), np.array([skip[e] for e in edges], bool))


_NO_SPACE = str.maketrans("", "", " ()")
N_LABELS = len(ALL_KINDS) + 1


@dataclass
class Field:
    """Log potentials: of a token's features, of neighbours in the chain, and of skip edges with equal labels
    (short and long likenesses)."""

    node: np.ndarray
    chain: np.ndarray
    skip: np.ndarray

    def marginals(self, g: Graph, rounds: int = ROUNDS) -> np.ndarray:
        """Loopy sum-product; known tokens are clamped."""
        n = len(g.spans)
        local = np.exp(np.clip(g.x @ self.node, -30, 30))
        local[g.known >= 0] = 0
        local[g.known >= 0, g.known[g.known >= 0]] = 1
        pairs = np.concatenate([g.chain, g.skip])
        if not len(pairs):
            return local / local.sum(axis=1, keepdims=True)
        source, target = np.concatenate([pairs[:, 0], pairs[:, 1]]), np.concatenate([pairs[:, 1], pairs[:, 0]])
        # the kinds of edges: the chain forward, the short and the long likeness, the chain backward
        weights = np.exp(np.stack([self.chain, self.skip[0] * np.eye(N_LABELS), self.skip[1] * np.eye(N_LABELS), self.chain.T]))
        kind = np.concatenate([np.zeros(len(g.chain), int), 1 + g.long.astype(int)])
        kind = np.concatenate([kind, np.where(kind == 0, 3, kind)])
        back = np.concatenate([np.arange(len(pairs)) + len(pairs), np.arange(len(pairs))])
        messages = np.full((len(source), N_LABELS), 1 / N_LABELS)
        for _ in range(rounds):
            logs = np.zeros((n, N_LABELS))
            np.add.at(logs, target, np.log(messages))
            outgoing = np.log(np.maximum(local[source], 1e-300)) + logs[source] - np.log(messages[back])
            outgoing = np.exp(outgoing - outgoing.max(axis=1, keepdims=True))
            new = np.empty_like(outgoing)
            for k, weight in enumerate(weights):
                new[kind == k] = outgoing[kind == k] @ weight
            new = np.maximum(new / new.sum(axis=1, keepdims=True), 1e-12)
            moved = np.abs(new - messages).max()
            messages = 0.5 * messages + 0.5 * new
            if moved < 1e-4:
                break
        logs = np.log(np.maximum(local, 1e-300))
        np.add.at(logs, target, np.log(messages))
        out = np.exp(logs - logs.max(axis=1, keepdims=True))
        return out / out.sum(axis=1, keepdims=True)


#: What the skip potentials (short, long) are drawn to where training says little.
SKIP_PRIOR = np.array([0.5, 4.0])
#: Of the squared distance of each potential from its prior.
PENALTY = 3e-5


def secrets(text: str) -> list[Span]:
    """The values of assignments to a name of ASSIGNED."""
    found = []
    for m in _ASSIGNMENT.finditer(text):
        value = _TOKEN.search(text, m.end(), m.end() + 300)
        if value and _CUE.search(text, m.start(), value.start()) and len(value.group()) >= SECRET_CHARS and _ANY.search(value.group()):
            found.append((value.start(), value.end(), SECRET))
    return found


def variants(value: str, kind: int) -> list[str]:
    """Other ways to write a value, without what its pattern needs."""
    digits = "".join(c for c in value if c in "0123456789")
    if kind == 0:
        name = value.split("@")[0]
        return [value.upper(), *([name] if _ANY.search(name) else [])]
    if kind == 2:
        return [digits + "0", "****" + digits[-4:], digits[:4] + "." + digits[4:]]
    if kind == 3:
        return [digits, digits[-10:], "***" + digits[-4:]]
    return [value, value.upper()]


def labelled(text: str) -> Graph:
    """The graph of a training text with its labels as what is known, further forms of its values appended."""
    truth = sorted({*base_spans(text), *secrets(text)}, key=lambda s: (s[0], s[2], s[1]))
    parts, at = [text], len(text)
    for k, (start, end, kind) in enumerate([*truth]):
        if start % 2:
            continue  # half of the values stay without another form: their own looks have to tell
        ways = variants(text[start:end], kind)
        way = ways[k % len(ways)]
        truth.append((at + 6, at + 6 + len(way), kind))
        parts.append(f"\nsee: {way}")
        at += 6 + len(way)
    g = graph("".join(parts), truth)
    far = g.skip[g.long].tolist()
    for a, b in [*far, *((b, a) for a, b in reversed(far))]:  # in order of the text, then backward
        if g.known[a] > 0 > g.known[b]:
            g.known[b] = g.known[a]
    return g


def fit(texts: list[str], rounds: int = 600) -> Field:
    """Pseudo-likelihood: each token's label given its features and its neighbours' labels, by Adam
    with a quadratic penalty around the prior."""
    graphs = [g for t in texts if len((g := labelled(t)).spans)]
    field = Field(np.zeros((N_FEATURES, N_LABELS)), np.zeros((N_LABELS, N_LABELS)), SKIP_PRIOR.copy())
    if not graphs:
        field.node[0, 0] = 1.0
        return field
    x = np.concatenate([g.x for g in graphs])
    y = np.concatenate([np.maximum(g.known, 0) for g in graphs])
    shift = np.cumsum([0, *(len(g.spans) for g in graphs)])
    chain = np.concatenate([g.chain + s for g, s in zip(graphs, shift, strict=False)])
    skip = np.concatenate([g.skip + s for g, s in zip(graphs, shift, strict=False)])
    long = np.concatenate([g.long for g in graphs]).astype(int)
    one = np.eye(N_LABELS)[y]
    n = len(y)
    parts = [field.node, field.chain, field.skip]
    prior = [np.zeros_like(field.node), np.zeros_like(field.chain), SKIP_PRIOR]
    first, second = [np.zeros_like(x) for x in parts], [np.zeros_like(x) for x in parts]
    for step in range(1, rounds + 1):
        z = x @ field.node
        np.add.at(z, chain[:, 1], field.chain[y[chain[:, 0]]])
        np.add.at(z, chain[:, 0], field.chain[:, y[chain[:, 1]]].T)
        np.add.at(z, skip[:, 1], field.skip[long][:, None] * one[skip[:, 0]])
        np.add.at(z, skip[:, 0], field.skip[long][:, None] * one[skip[:, 1]])
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        d = one - p
        to_chain = np.zeros_like(field.chain)
        np.add.at(to_chain, y[chain[:, 0]], d[chain[:, 1]])
        np.add.at(to_chain.T, y[chain[:, 1]], d[chain[:, 0]])
        to_skip = (d[skip[:, 1]] * one[skip[:, 0]]).sum(axis=1) + (d[skip[:, 0]] * one[skip[:, 1]]).sum(axis=1)
        for k, up in enumerate((x.T @ d, to_chain, np.bincount(long, to_skip, 2))):
            g = up / n - PENALTY * (parts[k] - prior[k])
            first[k] += 0.1 * (g - first[k])
            second[k] += 0.01 * (g * g - second[k])
            parts[k] += 0.1 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
    return field


def train(docs: DataFrame, sample: int = SAMPLE) -> Field:
    usable = docs.where(F.col("text").rlike("[0-9@+]")).select("doc_id", "text")
    order = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 30))
    n = docs.count()
    share = min(1.0, 40 * sample / max(1, n))
    rows = usable.where(order < F.lit(int(share * (1 << 30)))).orderBy(order, "doc_id", "text").limit(sample).collect()
    return fit([r["text"] for r in rows])


def added_spans(text: str, base: list[Span], field: Field, least: float = LEAST) -> list[Span]:
    """Spans that message passing gives beyond the base spans."""
    if not base and not _ASSIGNMENT.search(text):
        return []  # nothing is known and nothing assigned: no token could get a kind
    g = graph(text, base)
    if (g.known >= 0).all():
        return []
    group = list(range(len(g.spans)))

    def top(k: int) -> int:
        while group[k] != k:
            group[k] = group[group[k]]
            k = group[k]
        return k

    for a, b in [*g.chain.tolist(), *g.skip.tolist()]:
        group[top(a)] = top(b)
    kinds: dict[int, set[int]] = {}
    for k, label in enumerate(g.known.tolist()):
        if label > 0:
            kinds.setdefault(top(k), set()).add(label)
    for k in np.flatnonzero(g.x[:, _CUED] > 0).tolist():
        kinds.setdefault(top(k), set()).add(SECRET + 1)
    if not any(g.known[k] < 0 and top(k) in kinds for k in range(len(g.spans))):
        return []
    p = field.marginals(g)
    linked = {tuple(e) for e in g.chain.tolist()}
    found: list[Span] = []
    last = -1
    at = 0
    by_end = sorted(base, key=lambda s: s[1])
    for k, (start, end) in enumerate(g.spans):
        label = int(p[k].argmax())
        if g.known[k] >= 0 or not label or p[k, label] < least or label not in kinds.get(top(k), ()):
            continue
        while at < len(by_end) and by_end[at][1] <= start:
            at += 1
        if any(b[0] < end and b[1] > start for b in by_end[at : at + 4]):
            continue
        if found and last == k - 1 and found[-1][2] == label - 1 and (last, k) in linked:
            found[-1] = (found[-1][0], end, label - 1)
        else:
            found.append((start, end, label - 1))
        last = k
    return found


def listed(spans: list[Span]) -> str:
    return ",".join(f"{ALL_KINDS[k]}:{a}:{b}" for a, b, k in spans)


def find(docs: DataFrame, field: Field) -> DataFrame:
    """Per row: doc_id, the counts of base spans, base (text of the base spans) and spans (of all)."""
    sent = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            counts: list[list[int]] = [[], [], [], []]
            base_text, all_text = [], []
            for text in pc.fill_null(batch.column(1), "").to_pylist():
                if not _ANY.search(text):
                    for column in counts:
                        column.append(0)
                    base_text.append("")
                    all_text.append("")
                    continue
                base = base_spans(text)
                for k in range(4):
                    counts[k].append(sum(s[2] == k for s in base))
                base_text.append(listed(base))
                more = added_spans(text, base, sent.value)
                all_text.append(listed(sorted([*base, *more], key=lambda s: (s[0], s[2], s[1]))))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64()) for c in counts], pa.array(base_text, pa.string()), pa.array(all_text, pa.string())], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base", "spans"])

    source = only(docs, "doc_id", "text")
    return mapped(source, run, source.schema.fields[0].simpleString().replace(":", " ") + ", n_email long, n_ip long, n_card long, n_phone long, base string, spans string")
