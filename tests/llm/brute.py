"""Plain versions of the operators, row by row, for small tables."""

import base64
import hashlib
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _marked(docs, depth):
    """For each id its bytes and a mark for each byte that a string of depth bytes covers which starts earlier too."""
    seen, out = set(), {}
    for doc, text in sorted(docs):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - depth + 1):
            s = raw[i : i + depth]
            if s in seen:
                gone[i : i + depth] = b"\1" * depth
            seen.add(s)
        out[doc] = raw, gone
    return out


def kept_bytes(docs, depth=100):
    return {doc: bytes(b for b, g in zip(raw, gone) if not g) for doc, (raw, gone) in _marked(docs, depth).items()}


def spans_removed(docs, depth=100):
    """docs: (id, text); for each id (n_bytes, n_removed, n_spans, kept_sha256)."""
    kept = kept_bytes(docs, depth)
    return {doc: (len(raw), len(raw) - len(kept[doc]), len(re.findall(rb"\x01+", bytes(gone))), hashlib.sha256(kept[doc]).hexdigest()) for doc, (raw, gone) in _marked(docs, depth).items()}


def components(docs, size=4, percent=80):
    """docs: (id, text); for each id (n_shingles, component)."""
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for doc, text in docs:
        words = WORD.findall((text or "").translate(low))
        sets[doc] = {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if len(words) >= size else ({tuple(words)} if words else set())
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for d, s in sets.items():
        for g in s:
            holders[g].append(d)
    common = Counter()
    for ids in holders.values():
        for i, a in enumerate(ids):
            for b in ids[i + 1 :]:
                common[a, b] += 1
    for (a, b), n in common.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {d: (len(s), root(d)) for d, s in sets.items()}


def edited_texts(docs):
    """docs: (id, text); for each id the edited text and the next document's."""
    order = sorted(((d, t or "") for d, t in docs), key=lambda x: (-x[0], x[1]))
    out = {}
    for i, (d, t) in enumerate(order):
        nxt = order[(i + 1) % len(order)][1]
        half = len(t) // 2
        out[d] = (t, t[: len(t) - half] + nxt[:half], nxt)
    return out


def paragraphs(text):
    return {p.strip(" ") for p in re.sub(r"([.!?]) +", r"\1\n", text).split("\n")} - {""}


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def rank_encoding():
    import public_tokenizers as P
    import tiktoken

    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def held_out(doc, n):
    return zlib.crc32(str(doc).encode()) % n
