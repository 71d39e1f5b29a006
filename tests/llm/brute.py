"""Plain Python versions of the document operators, for small inputs."""

import hashlib
import re
import string

ASCII_LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def sha(data) -> str:
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def space_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def jaccard_components(docs, words=5, percent=80):
    """{id: (set size, component)}"""
    sets = {}
    for d, t in docs:
        w = space_words((t or "").translate(ASCII_LOWER))
        sets[d] = {tuple(w[i:i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(s), find(d)) for d, s in sets.items()}


def repeated_bytes(docs, length):
    """{id: (bytes, removed, spans, kept bytes)}"""
    data = {d: (t or "").encode() for d, t in docs}
    count = {}
    for b in data.values():
        for i in range(len(b) - length + 1):
            count[b[i:i + length]] = count.get(b[i:i + length], 0) + 1
    out = {}
    for d, b in data.items():
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if count[b[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out[d] = (len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), kept)
    return out


def repeated_words(docs, length):
    """{id: (words, removed, kept text)}"""
    seen, out = set(), {}
    for d, t in sorted(docs):
        w = space_words(t)
        keep = [True] * len(w)
        for i in range(len(w) - length + 1):
            window = tuple(w[i:i + length])
            if window in seen:
                keep[i:i + length] = [False] * length
            seen.add(window)
        out[d] = (len(w), len(w) - sum(keep), " ".join(x for x, k in zip(w, keep) if k))
    return out


def contaminated(docs, items, window=10):
    """{id: (words, hit, items)}"""
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(ASCII_LOWER))
    known = {}
    for i, t in items:
        w = split(t)
        n = min(window, len(w))
        if n and i is not None:
            for a in range(len(w) - n + 1):
                known.setdefault(tuple(w[a:a + n]), set()).add(str(i))
    out = {}
    for d, t in docs:
        w, hit, found = split(t), set(), set()
        for n in {len(k) for k in known}:
            for a in range(len(w) - n + 1):
                if (k := tuple(w[a:a + n])) in known:
                    hit |= set(range(a, a + n))
                    found |= known[k]
        out[d] = (len(w), len(hit), sorted(found))
    return out


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_spans(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "email" or kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")) \
                    or kind == "card" and 13 <= len(digits) <= 19 and luhn(digits) \
                    or kind == "phone" and 9 <= len(digits) <= 15:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def maximal_runs(words, repeats=4, shortest=6):
    """[(start, length, period)] by start and period, from all periods."""
    n, best = len(words), {}
    for q in range(1, n // repeats + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(shortest, repeats * q):
                best.setdefault((i, j + q - i), q)  # smaller periods come first
            i = j
    return sorted((s, k, q) for (s, k), q in best.items())


def with_repeated_tail(doc_id, words):
    import zlib

    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def packed_ids(text):
    """ids with the end id, by the library alone."""
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]


def binary_pieces(n, longest=2048):
    """[(start, length)]"""
    out, start = [], 0
    while n - start:
        size = longest
        while size > n - start:
            size //= 2
        out.append((start, size))
        start += size
    return out


def aligned(docs):
    """{row: (doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, digest)}"""
    import json

    import public_tokenizers
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    one = Tokenizer.from_file(path)
    one.encode_special_tokens = True
    two = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    back = {**{chr(b): b for b in shown}, **{chr(256 + i): b for i, b in enumerate(hidden)}}
    vocab = {i: bytes(back[c] for c in w) for w, i in json.load(open(path))["model"]["vocab"].items()}

    def piece(i):
        p = two.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if two.is_byte(i) else p.replace("▁", " ").encode()

    out, links = {}, {}
    for row, (doc_id, text) in enumerate(docs):
        out[row], links[row] = (doc_id, 0, 0, 0, 0, 0, 0, ""), {}
        if not text:
            continue
        a, b = one.encode(" " + text, add_special_tokens=False).ids, two.encode(text)
        spelt = [[vocab[i] for i in a], [piece(i) for i in b]]
        if any(b"".join(s) != (" " + text).encode() for s in spelt):
            continue
        ends = []
        for s in spelt:
            at, mine = 0, []
            for t in s:
                at += len(t)
                mine.append(at)
            ends.append(mine)
        groups, i, j = [], 0, 0
        for cut in sorted(set(ends[0]) & set(ends[1])):
            x, y = ends[0].index(cut, i) + 1, ends[1].index(cut, j) + 1
            groups.append((a[i:x], b[j:y]))
            i, j = x, y
        for x, y in groups:
            for p in x:
                for q in y:
                    links[row][p, q] = links[row].get((p, q), 0) + 1
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out[row] = (doc_id, len(a), len(b), len(groups), sum(links[row].values()), 0, 0, sha(text))
    count, highest = {}, {}
    for mine in links.values():
        for pair in mine:
            count[pair] = count.get(pair, 0) + 1
    for (p, _), n in count.items():
        highest[p] = max(n, highest.get(p, 0))
    for row, mine in links.items():
        best = sum(n for pair, n in mine.items() if count[pair] == highest[pair[0]])
        total = sum(n * count[pair] for pair, n in mine.items())
        out[row] = (*out[row][:5], best, total, out[row][7])
    return out
