"""Personal data by weak supervision.

Base patterns find e-mail addresses, IPv4 addresses, card and phone numbers.
Further candidate spans (assigned secrets, national phone numbers, spelled-out
addresses, names after a form of address or beginning with a given name, failed
base matches) are judged by labelers, each of which votes yes or no: the strict
pattern of the kind, gazetteers of given names and of words that announce a kind,
the context on either side, and the shape.

1. All documents are scanned for candidates, which are counted by kind and votes.
2. Expectation-maximisation over those counts (a two-class Dawid-Skene model)
   estimates each labeler's reliability and the probability of every kind and
   vote pattern: the statistics are those of the whole corpus.
3. A logistic span classifier is trained with those probabilities as targets, on
   at most ``PER_CELL`` candidates of each kind and vote pattern, weighed by the
   pattern's count.  It sees the votes, and also the span (its shape, ends and
   length) and its context (the words before it, the sign behind it).
4. All documents are scanned again: base spans stay, and candidates that the
   classifier gives at least ``ACCEPT`` are added where they touch no base span.

Defined results: a null text is an empty one; offsets are code points, ends
exclusive.  Of candidates of one kind that overlap the first counts.  Without
candidates nothing is added.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.llm.common import append_columns, checkpoint, documents
from sparkloom.llm.textops import Slice

KINDS = ("email", "ip", "card", "phone", "name", "secret")
ACCEPT = 0.9

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# the look-behind changes no match: a run of digits matches from its start or not at all
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# what stands before these is looked at afterwards: patterns that begin with a sign are searched faster
_NATIONAL = re.compile(r"\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?!\w)")
_SPELLED = re.compile(r"[\[(]at[\])]|[\[(]AT[\])]")
_ASSIGNED = re.compile(r"[=:][ \t]?[\"']?([A-Za-z0-9+/_-]{8,})")
_ADDRESSED = re.compile(r"(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Monsieur|Señor|Señora)\.? ([^\W\d_]+(?: [^\W\d_]+)?)")

#: Words that announce a kind, looked for in the text just before a span (English, French, German, Spanish).
GAZETTEER = {
    "email": (
        "adresse", "address", "an:", "contact", "contacto", "contactez", "correo", "courriel", "e-mail", "email", "escriba", "from",
        "kontakt", "mail", "reply", "schreib", "to:", "write to", "écrivez",
    ),
    "ip": ("address", "adresse", "client", "dirección", "from", "gateway", "host", "ip", "login", "proxy", "server", "servidor", "serveur"),
    "card": (
        "account", "amex", "card", "carte", "compte", "credit", "cuenta", "débito", "karte", "konto", "kreditkarte", "mastercard",
        "payment", "tarjeta", "visa",
    ),
    "phone": (
        "anruf", "appel", "appelez", "call", "cell", "contact", "fax", "handy", "llame", "mobile", "móvil", "phone", "portable", "ruf",
        "tel", "teléfono", "téléphone", "whatsapp",
    ),
    "name": (
        "atentamente", "author", "auteur", "autor", "by", "cordialement", "dear", "estimad", "from", "gruß", "grüße", "name", "nom",
        "nombre", "patient", "regards", "signed", "sincerely", "von",
    ),
    "secret": (
        "access_key", "api key", "api_key", "apikey", "auth", "bearer", "clave", "client_secret", "contraseña", "credential", "key",
        "kennwort", "mot de passe", "passwd", "password", "passwort", "pwd", "schlüssel", "secret", "token",
    ),
}
#: Common given names.
GIVEN = (
    "Alejandro", "Alice", "Andrea", "Anna", "Anne", "Antonio", "Benjamin", "Camille", "Carlos", "Carmen", "Catherine", "Charles",
    "Christian", "Christine", "Claire", "Daniel", "David", "Diego", "Elena", "Elizabeth", "Emily", "Emma", "Eva", "Felix", "Fernando",
    "Francisco", "François", "Friedrich", "Hans", "Heinrich", "Hélène", "Isabel", "Jack", "James", "Jane", "Javier", "Jean", "Jennifer",
    "Johann", "John", "Jorge", "José", "Juan", "Julia", "Karl", "Katharina", "Laura", "Lucas", "Lucía", "Luis", "Manuel", "Maria",
    "María", "Marie", "Mark", "Martin", "Mary", "Matthias", "Michael", "Miguel", "Nicolas", "Olivia", "Pablo", "Patricia", "Paul",
    "Pedro", "Peter", "Philippe", "Pierre", "Robert", "Sarah", "Sophie", "Stefan", "Susan", "Thomas", "Ursula", "William", "Wolfgang",
)
#: A capitalised word before another one; whether it is a given name is looked up.
_CAPITALISED = re.compile(r"([A-ZÀ-ÖØ-Þ][^\W\d_]+) (?=[^\W\d_a-zß-ÿ]([^\W\d_]+))")
_MIXED = re.compile(r"[0-9][^0-9]|[^0-9][0-9]|[a-z][A-Z]")
_FIRST_WORD = re.compile(r"[^\W\d_]+")
GIVEN_SET = frozenset(GIVEN)
BEFORE = 24
VOTES = ("pattern", "gazetteer", "left", "right", "shape")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if i % 2:
            n = n * 2 - 9 * (n > 4)
        total += n
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    at, floor = text.find("@"), 0
    while at >= 0:
        lo = at
        while lo > floor and text[lo - 1] in _LOCAL:
            lo -= 1
        found = _DOMAIN.match(text, at) if lo < at else None
        if found:
            floor = found.end()
            yield lo, floor
        at = text.find("@", max(at + 1, floor))


def _digits(s: str) -> str:
    return "".join([c for c in s if "0" <= c <= "9"])


def base_and_failed(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(kind, start, end) of base spans by kind and start, and of matches that failed their check."""
    base = [(0, a, b) for a, b in _emails(text)]
    failed = []
    if _has_digit(text):
        for m in _IP.finditer(text):
            valid = all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0")[:4] or 0) <= 255 for p in m[0].split("."))
            (base if valid else failed).append((1, *m.span()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 16:
                digits = _digits(m[0])
                if len(digits) >= 16:
                    (base if len(digits) <= 19 and luhn(digits) else failed).append((2, *m.span()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                (base if 8 <= len(_digits(m[0])) <= 15 else failed).append((3, *m.span()))
    return base, failed


_DIGIT = re.compile("[0-9]")


def _has_digit(text: str) -> bool:
    return _DIGIT.search(text) is not None


def _begins(text: str, at: int, beside: str) -> bool:
    """Whether no letter, digit or sign of ``beside`` stands before a place."""
    return at == 0 or not (text[at - 1].isalnum() or text[at - 1] in beside)


def _entropy(s: str) -> float:
    _, n = np.unique(np.frombuffer(s.encode("utf-32-le"), np.uint32), return_counts=True)
    p = n / n.sum()
    return float(-(p * np.log2(p)).sum())


def candidates(text: str, base: list[tuple[int, int, int]], failed: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int]]:
    """(kind, start, end, votes) of spans that no base span touches; votes as a bit mask over VOTES."""
    found = [(k, a, b, False) for k, a, b in failed]
    if _has_digit(text):
        found += [(3, *m.span(), True) for m in _NATIONAL.finditer(text) if _begins(text, m.start(), "_+")]
    for m in _SPELLED.finditer(text):
        left = re.search(r"[\w.+-]{1,64} ?\Z", text[max(0, m.start() - 65) : m.start()])
        right = re.match(r" ?[\w-]{1,64}(?: ?[\[(](?:dot|DOT)[\])] ?[\w-]{1,64}|\.[\w-]{1,64})+", text[m.end() : m.end() + 260])
        if left and right:
            found.append((0, m.start() - len(left[0]), m.end() + right.end(), True))
    if "=" in text or ":" in text:
        for m in _ASSIGNED.finditer(text):
            token = m[1]
            strict = len(token) >= 16 and any(c.isdigit() for c in token) and any(c.isalpha() for c in token)
            found.append((5, *m.span(1), strict))
    found += [(4, *m.span(1), m[1].istitle()) for m in _ADDRESSED.finditer(text) if _begins(text, m.start(), "_")]
    found += [(4, m.start(), m.end(2), True) for m in _CAPITALISED.finditer(text) if m[1] in GIVEN_SET and _begins(text, m.start(), "")]
    if not found:
        return []
    # base spans as maximal runs, so that one look-up tells whether a candidate touches any
    edges: list[int] = []
    for a, b in sorted((a, b) for _, a, b in base):
        if edges and a < edges[-1]:
            edges[-1] = max(edges[-1], b)
        else:
            edges += [a, b]
    out = []
    last_end = {}
    for kind, a, b, strict in sorted(found):
        k = bisect_left(edges, a + 1)
        if k % 2 or (k < len(edges) and edges[k] < b) or a < last_end.get(kind, 0):
            continue
        last_end[kind] = b
        before = text[max(0, a - BEFORE) : a].lower()
        token = text[a:b]
        listed = any(w in before for w in GAZETTEER[KINDS[kind]])
        if kind == 4:
            listed |= _FIRST_WORD.match(token)[0] in GIVEN_SET
        # a secret is no word: it mixes digits or capitals into its letters
        shape = _entropy(token) > 3 and _MIXED.search(token) is not None if kind == 5 else 4 <= b - a <= 40
        votes = (
            strict
            | listed << 1
            | (a == 0 or not text[a - 1].isalnum()) << 2
            | (b == len(text) or not text[b].isalnum()) << 3
            | shape << 4
        )
        out.append((kind, a, b, int(votes)))
    return out


FEATURE_BITS = 14
_RUN = re.compile(r"(A|a|9)\1+")


def _shape(token: str) -> str:
    """Capitals, small letters and digits as A, a and 9, and runs of one of them as one."""
    return _RUN.sub(r"\1", "".join(["9" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else c for c in token]))


def span_features(text: str, kind: int, a: int, b: int, votes: int) -> list[int]:
    """Buckets of what the span classifier sees: kind and votes (buckets of their own), span and context (hashed)."""
    out = [kind] + [8 + 2 * (kind * len(VOTES) + j) + (votes >> j & 1) for j in range(len(VOTES))]
    token = text[a : min(b, a + 80)]
    before = text[max(0, a - BEFORE) : a].lower().split()[-2:]
    size = min(b - a, 80).bit_length()
    said = [f"shape {_shape(token)}", f"first {token[:2]}", f"last {token[-2:]}", f"size {size}", f"after {text[b : b + 1]}"]
    said += [f"before {w}" for w in before]
    room = (1 << FEATURE_BITS) - 128
    return out + [128 + zlib.crc32(f"{kind} {s}".encode()) % room for s in said]


#: Candidates of each kind and vote pattern that the span classifier is trained on, at most.
PER_CELL = 200
#: Weight and vote rates of the anchors: pseudo-candidates of either class.
ANCHOR = 20.0
_YES = np.array([0.9, 0.9, 0.9, 0.9, 0.9])
_NO = np.array([0.1, 0.1, 0.8, 0.8, 0.8])


@dataclass
class SpanModel:
    """Weights of the span classifier's features, and each labeler's rates of yes on true and on false spans."""

    weight: np.ndarray
    reliability: dict[str, tuple[float, float]]

    def probability(self, features: list[int]) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.weight[features].sum(), -30, 30))))


def reliabilities(counts: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, dict[str, tuple[float, float]]]:
    """By expectation-maximisation over counts by kind and votes: each cell's probability, each labeler's rates."""
    patterns = np.arange(1 << len(VOTES))
    bits = (patterns[:, None] >> np.arange(len(VOTES)) & 1).astype(float)
    share = np.tile(bits.mean(axis=1), (len(KINDS), 1))
    for _ in range(rounds):
        yes, no = counts * share, counts * (1 - share)
        # labelers' reliabilities are shared by all kinds; the anchors keep the classes from changing places
        hit = (yes.sum(axis=0) @ bits + ANCHOR * _YES) / (yes.sum() + ANCHOR)
        false = (no.sum(axis=0) @ bits + ANCHOR * _NO) / (no.sum() + ANCHOR)
        prior = ((yes.sum(axis=1) + 1) / (counts.sum(axis=1) + 2))[:, None]
        up = np.log(prior) + (bits @ np.log(hit) + (1 - bits) @ np.log(1 - hit))
        down = np.log(1 - prior) + (bits @ np.log(false) + (1 - bits) @ np.log(1 - false))
        share = 1 / (1 + np.exp(np.clip(down - up, -50, 50)))
    return share, {v: (float(hit[j]), float(false[j])) for j, v in enumerate(VOTES)}


def fit(cells: list[tuple[int, int, int]], examples: list[tuple[int, int, list[int]]], epochs: int = 30, seed: int = 3) -> SpanModel:
    """``cells``: (kind, votes, count) over the whole corpus; ``examples``: (kind, votes, features) of some candidates."""
    counts = np.zeros((len(KINDS), 1 << len(VOTES)))
    for kind, votes, n in cells:
        counts[kind, votes] += n
    share, reliability = reliabilities(counts)
    shown = np.zeros(counts.shape)
    for kind, votes, _ in examples:
        shown[kind, votes] += 1
    rows = [(f, share[k, v], np.log1p(counts[k, v]) / shown[k, v]) for k, v, f in examples]
    # cells that the corpus lacks keep some weight, so that the classifier stays close to the labelers there
    rows += [(span_features("", k, 0, 0, v)[: 1 + len(VOTES)], share[k, v], 0.5) for k, v in np.ndindex(*counts.shape)]
    size = 1 << FEATURE_BITS
    x = np.full((len(rows), max(len(f) for f, _, _ in rows)), size)  # the last weight is that of absent features
    for line, (f, _, _) in zip(x, rows, strict=True):
        line[: len(f)] = f
    y, weight = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    w, squares = np.zeros(size + 1), np.full(size + 1, 1e-6)
    rng = np.random.RandomState(seed)
    for _ in range(epochs):
        for some in np.array_split(rng.permutation(len(rows)), max(1, len(rows) // 64)):
            p = 1 / (1 + np.exp(-np.clip(w[x[some]].sum(axis=1), -30, 30)))
            error = np.repeat(weight[some] * (p - y[some]), x.shape[1])
            gradient = np.bincount(x[some].ravel(), error, size + 1) + 1e-4 * w
            gradient[size] = 0
            squares += gradient**2
            w -= 0.3 * gradient / np.sqrt(squares)
    return SpanModel(w[:size].astype(np.float32), reliability)


_CANDIDATE = T.StructType([T.StructField("cell", T.IntegerType()), T.StructField("features", T.ArrayType(T.IntegerType()))])


def scan_candidates(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(kind, votes, features) of the candidates of all documents."""
    width = 1 << len(VOTES)

    def step(part: Slice) -> list:
        out = []
        for i in range(len(part)):
            text = part.text(i)
            found = candidates(text, *base_and_failed(text))
            out.append([{"cell": c[0] * width + c[3], "features": span_features(text, *c)} for c in found])
        return [out]

    cells = append_columns(docs.select(text_col), text_col, [T.StructField("found", T.ArrayType(_CANDIDATE))], lambda: step)
    return cells.select(F.explode("found").alias("c")).select(
        (F.col("c.cell") / width).cast("int").alias("kind"), (F.col("c.cell") % width).alias("votes"), F.col("c.features").alias("features")
    )


def train(docs: DataFrame, text_col: str = "text", per_cell: int = PER_CELL) -> SpanModel:
    found = checkpoint(scan_candidates(docs, text_col))
    cells = found.groupBy("kind", "votes").count().collect()  # kinds x vote patterns at most
    order = Window.partitionBy("kind", "votes").orderBy(F.xxhash64("features"), "features")
    some = found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= per_cell)
    examples = some.select("kind", "votes", "features").collect()  # per_cell for each of those at most
    return fit([tuple(r) for r in cells], sorted(tuple(r) for r in examples))


def find_spans(text: str, model: SpanModel) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and all spans, by kind and start."""
    base, failed = base_and_failed(text)
    added = [c[:3] for c in candidates(text, base, failed) if model.probability(span_features(text, *c)) >= ACCEPT]
    return base, sorted(base + added)


def _written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each maximal run of overlapping spans replaced by its first kind in angle brackets."""
    out, at, end = [], 0, -1
    for a, b, kind in sorted((a, b, k) for k, a, b in spans):
        if a >= end:
            out += [text[at:a], f"<{KINDS[kind]}>"]
        end = max(end, b)
        at = end
    return "".join([*out, text[at:]]) if out else text


#: What ``personal_data`` appends.
COLUMNS = (*[f"n_{k}" for k in KINDS[:4]], "base_sha256", "spans")


def personal_data(docs: DataFrame, model: SpanModel, text_col: str = "text", redacted_col: str | None = None) -> DataFrame:
    """Append counts, ``base_sha256`` and ``spans``; with ``redacted_col`` also the text with its spans replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**FEATURE_BITS floats
    fields = [T.StructField(f"n_{k}", T.LongType()) for k in KINDS[:4]]
    fields += [T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())]
    if redacted_col:
        fields.append(T.StructField(redacted_col, T.StringType()))

    def make():
        spans_of = shared.value

        def step(part: Slice) -> list:
            out: list[list] = [[] for _ in fields]
            for i in range(len(part)):
                text = part.text(i)
                base, spans = find_spans(text, spans_of)
                row = [sum(k == kind for k, _, _ in base) for kind in range(4)]
                row += [hashlib.sha256(_written(base).encode()).hexdigest(), _written(spans)]
                if redacted_col:
                    row.append(redact(text, spans))
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            return out

        return step

    return append_columns(docs, text_col, fields, make)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return personal_data(docs, train(docs)).drop("text")
