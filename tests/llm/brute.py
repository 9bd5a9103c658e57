"""Plain reference versions of operators, for small inputs."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def shingles(text: str | None, width: int = 5) -> frozenset:
    words = WORD.findall((text or "").translate(LOWER))
    if len(words) < width:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[k : k + width]) for k in range(len(words) - width + 1))


def jaccard_components(rows, width: int = 5, percent: int = 75):
    """{doc_id: (n_shingles, component_id)} by comparing all pairs."""
    sets = {i: shingles(t, width) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def suffix_dedup(texts, length, keep):
    """(n_bytes, n_removed, n_spans, kept bytes) of each text."""
    raw = [(t or "").encode() for t in texts]
    count = Counter(b[p : p + length] for b in raw for p in range(len(b) - length + 1))
    seen: set[bytes] = set()
    out = []
    for b in raw:
        gone = [False] * len(b)
        for p in range(len(b) - length + 1):
            factor = b[p : p + length]
            if factor in seen if keep == "first" else count[factor] > 1:
                gone[p : p + length] = [True] * length
            seen.add(factor)
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def piece_edits(item: str, text: str, size: int) -> int:
    """The fewest edits between a piece of ``size`` characters of an item and a passage of a text."""
    letters, along = np.array(list(text), dtype="U1"), np.arange(len(text) + 1)
    pieces = np.array([list(item[s : s + size]) for s in range(len(item) - size + 1)])
    rows = np.zeros((len(pieces), len(text) + 1), int)
    for t in range(size):
        new = rows + 1
        new[:, 1:] = np.minimum(new[:, 1:], rows[:, :-1] + (letters != pieces[:, t : t + 1]))
        rows = np.minimum.accumulate(new - along, axis=1) + along
    return int(rows.min())


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(int(c) for c in reversed(digits)):
        total += d if i % 2 == 0 else (d * 2 if d < 5 else d * 2 - 9)
    return total % 10 == 0


def personal_data(text: str | None):
    """Base spans by kind, by the patterns as stated."""
    text = text or ""
    digits = lambda s: re.sub("[^0-9]", "", s)
    email = [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    ip = [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    card = [m.span() for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 16 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    phone = [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(digits(m[0])) <= 15]
    return {"email": email, "ip": ip, "card": card, "phone": phone}


def repeated_words(texts, length):
    """Words of each text that lie in a run of ``length`` words that another text has too."""
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    where: dict[tuple, set[int]] = {}
    for i, ws in enumerate(split):
        for k in range(len(ws) - length + 1):
            where.setdefault(tuple(ws[k : k + length]), set()).add(i)
    out = []
    for ws in split:
        hit = [False] * len(ws)
        for k in range(len(ws) - length + 1):
            if len(where[tuple(ws[k : k + length])]) > 1:
                hit[k : k + length] = [True] * length
        out.append(sum(hit))
    return out


def ngram_buckets(text: str, sizes, bits: int, lower: bool = False) -> list[int]:
    """Buckets of the byte n-grams inside words, with a blank at one end or none, one by one."""
    raw = text.encode()
    raw = bytes(32 if b in b" \t\n\v\f\r" else b + 32 if lower and 65 <= b <= 90 else b for b in raw)
    padded, out = b" " * 8 + raw + b" " * 8, []
    for n in sizes:
        for k in range(len(padded) - n + 1):
            gram = padded[k : k + n]
            if 32 in gram[1:-1] or (gram[0] == gram[-1] == 32):
                continue
            value = (int.from_bytes(gram, "little") + (n << 56)) * 0x9E3779B97F4A7C15 % (1 << 64)
            value = (value ^ (value >> 29)) * 0xBF58476D1CE4E5B9 % (1 << 64)
            out.append(value >> (64 - bits))
    return out


def toxicity_score(text, model, sizes, bits: int) -> float:
    total = model.bias + sum(float(model.weight[b]) for b in set(ngram_buckets(text or "", sizes, bits, True)))
    return 1 / (1 + np.exp(-np.clip(total, -60, 60)))


def quality_score(text, model, word_bucket, sizes, bits: int, span: int) -> float:
    words = WORD.findall(text or "")
    buckets = [word_bucket(w) for w in words] + ngram_buckets(text or "", sizes, bits)
    buckets += [(1 << bits) + k - 1 for k in range(1, span + 1) for i in range(k, len(words)) if words[i] == words[i - k]]
    mean = sum(float(model.folded[b]) for b in buckets) / max(1, len(buckets))
    return 1 / (1 + np.exp(-np.clip(model.bias + mean, -60, 60)))


def ranked(docs, items, k: int):
    """{item_id: [(doc_id, score)]} of the k best documents, document after document."""
    term = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    own = [(i, Counter(term.findall((t or "").translate(LOWER)))) for i, t in docs]
    own = [(i, c, sum(c.values())) for i, c in own if c]
    n_docs, n_terms = len(own), sum(n for _, _, n in own)
    df = Counter(t for _, c, _ in own for t in c)
    out = {}
    for item, text in items:
        scores = []
        for i, c, n in own:
            m = 100 - 25 + 25 * n * n_docs // n_terms
            score = 0
            for t in term.findall((text or "").translate(LOWER)):
                if c[t]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += w * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m))
            if score > 0:
                scores.append((i, score))
        out[item] = sorted(scores, key=lambda x: (-x[1], x[0] is None, x[0]))[:k]
    return out


class Tokenizers:
    """Whole texts given to both tokenizers at once."""

    def __init__(self, a_path: str, b_path: str):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(a_path), SentencePieceProcessor(model_file=b_path)
        self.a.encode_special_tokens = True
        self.letters = {c: b for b, c in enumerate(self._letters())}

    @staticmethod
    def _letters():
        seen = 0
        for b in range(256):
            if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b:
                yield chr(b)
            else:
                yield chr(256 + seen)
                seen += 1

    def bytes_of_a(self, i: int) -> bytes:
        return bytes(self.letters[c] for c in self.a.id_to_token(i))

    def bytes_of_b(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:-1], 16)]) if self.b.is_byte(i) else piece.replace("\u2581", " ").encode()

    def align(self, rows):
        """The rows of the alignment query."""
        found, count = [], Counter()
        for i, text in rows:
            raw = (" " + (text or "")).encode()
            a, b = self.a.encode(raw.decode(), add_special_tokens=False).ids, self.b.encode(text or "")
            parts = [list(map(self.bytes_of_a, a)), list(map(self.bytes_of_b, b))]
            if not text or any(b"".join(p) != raw for p in parts):
                found.append((i, [], [], [], []))
                continue
            ends = [np.cumsum([len(x) for x in p]).tolist() for p in parts]
            cuts = sorted(set(ends[0]) & set(ends[1]))
            groups = [([], []) for _ in cuts]
            for side, ids in enumerate((a, b)):
                for x, e in zip(ids, ends[side], strict=True):
                    groups[next(k for k, c in enumerate(cuts) if c >= e)][side].append(x)
            links = [(x, y) for x, e in zip(a, ends[0], strict=True) for y, f in zip(b, ends[1], strict=True) if e == f]
            count.update(links)
            found.append((i, a, b, groups, links))
        high: dict[int, int] = {}
        for (_, y), n in count.items():
            high[y] = max(high.get(y, 0), n)
        for i, a, b, groups, links in found:
            written = ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)
            digest = hashlib.sha256(written.encode()).hexdigest() if groups else ""
            yield i, len(a), len(b), len(groups), len(links), sum(count[x] == high[x[1]] for x in links), sum(count[x] for x in links), digest
