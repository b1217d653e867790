"""Plain versions of the operators, for small tables."""

from __future__ import annotations

import base64
import hashlib

import xxhash


def equal_groups(rows):
    """{doc_id: (keep_id, group_size, kept, sha)} of (doc_id, text) rows with distinct ids."""
    groups = {}
    for doc, text in rows:
        groups.setdefault(text or "", []).append(doc)
    return {
        doc: (max(docs), len(docs), doc == max(docs), hashlib.sha256(text.encode()).hexdigest())
        for text, docs in groups.items()
        for doc in docs
    }


def fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes)) if hashes else 0


def near_groups(rows, different=2):
    """{doc_id: (fingerprint, component_id)} by comparing all pairs."""
    prints = {doc: fingerprint(text) for doc, text in rows}
    parent = {doc: doc for doc in prints}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    docs = sorted(prints)
    for n, a in enumerate(docs):
        for b in docs[n + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= different:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {doc: (format(prints[doc], "016x"), root(doc)) for doc in docs}


def edits(rows):
    """{doc_id: (n_chars, edited text)}; the next document is the one with the next smaller id."""
    ordered = sorted(((doc, text or "") for doc, text in rows), key=lambda r: -r[0])
    out = {}
    for n, (doc, text) in enumerate(ordered):
        half = len(text) // 2
        out[doc] = (len(text), text[: len(text) - half] + ordered[(n + 1) % len(ordered)][1][:half])
    return out


def winnowed(hashes, w, rank):
    """Places of the smallest rank of each window, the rightmost of equals."""
    if not hashes:
        return []
    ranks = [rank(h) for h in hashes]
    found = []
    for start in range(max(1, len(ranks) - w + 1)):
        window = ranks[start : start + w]
        place = start + max(i for i, r in enumerate(window) if r == min(window))
        if place not in found:
            found.append(place)
    return found


def records(rows):
    """{page_id: (bytes, digest, type, refers_to)}."""
    first = {}
    for page, html in sorted(rows):
        first.setdefault(html or "", page)
    out = {}
    for page, html in rows:
        raw, one = (html or "").encode(), first[html or ""]
        name = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        out[page] = (len(raw), name, "response" if one == page else "revisit", None if one == page else one)
    return out
