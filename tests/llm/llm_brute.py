"""Plain-Python models of the operators, for small tables. Rows are dicts with doc_id and text."""

import base64
import hashlib
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall(text or "")


def quality(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, kept (policy default-1)."""
    text = text or ""
    w = words(text)
    lines = [x for x in text.split("\n") if words(x)]
    grams = [tuple(w[i:i + 8]) for i in range(len(w) - 7)]
    often = Counter(grams)
    cover = {j for i, g in enumerate(grams) if often[g] > 1 for j in range(i, i + 8)}
    chars, symbols = sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text))
    kept = not (len(w) < 20 or 100 * len(cover) > 30 * len(w) or 5 * symbols > len(w) or chars < 2 * len(w)
                or chars > 12 * len(w))
    return len(w), chars, symbols, len(lines) - len(set(lines)), len(cover), kept


def within(a, b, edits):
    """Edit distance of byte strings if it is at most ``edits``."""
    if abs(len(a) - len(b)) > edits:
        return None
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        lo, hi = max(0, i - edits), min(len(b), i + edits + 1)
        new = [edits + 1] * (len(b) + 1)
        new[0] = i + 1
        for j in range(lo, hi):
            new[j + 1] = min(row[j] + (x != b[j]), new[j] + 1, row[j + 1] + 1)
        if min(new[lo:hi + 1]) > edits:
            return None
        row = new
    return row[-1] if row[-1] <= edits else None


def removed_lines(rows, edits=2, min_bytes=32):
    """{(doc_id, line): verdict} of lines with a word, and the links of each line."""
    places = [((r["doc_id"], n), x) for r in rows if r["doc_id"] is not None and r["text"] is not None
              for n, x in enumerate(r["text"].split("\n")) if words(x)]
    first = {}
    for place, x in places:
        first[x] = min(first.get(x, place), place)
    long = sorted((x.encode() for x in first if len(x.encode()) >= min_bytes), key=len)
    links = {x: set() for x in first}
    for i, x in enumerate(long):
        for y in long[i + 1:]:
            if len(y) - len(x) > edits:
                break
            if within(x, y, edits) is not None:
                links[x.decode()].add(y.decode())
                links[y.decode()].add(x.decode())
    verdict = {}
    for place, x in places:
        verdict[place] = 1 if place != first[x] else 2 if any(first[y] < first[x] for y in links[x]) else 0
    return verdict, links


def drop_lines(rows, edits=2, min_bytes=32):
    verdict, _ = removed_lines(rows, edits, min_bytes)
    out = []
    for r in rows:
        if r["text"] is None or not any(verdict.get((r["doc_id"], n)) for n in range(len(r["text"].split("\n")))):
            out.append(r)
            continue
        text = "\n".join(x for n, x in enumerate(r["text"].split("\n")) if not verdict.get((r["doc_id"], n)))
        if words(text):
            out.append({**r, "text": text})
    return out


def shingle_set(text, k):
    w = words((text or "").translate(LOWER))
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def groups(rows, k, percent=80):
    """{doc_id: (n_shingles, component)}."""
    sets = {r["doc_id"]: shingle_set(r["text"], k) for r in rows if r["doc_id"] is not None}
    label = {i: i for i in sets}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((root(a), root(b)))
                label[q] = p
    return {i: (len(sets[i]), root(i)) for i in ids}


def leaks(rows, items, percent=80):
    """{(doc_id, item_id): (matched, total)}."""
    grams = lambda t: Counter(tuple(w[i:i + 5]) for w in [words((t or "").lower())] for i in range(len(w) - 4))
    docs = [(r["doc_id"], grams(r["text"])) for r in rows]
    out = {}
    for item in items:
        want = grams(item["text"])
        for i, have in docs:
            matched = sum(min(n, have[g]) for g, n in want.items())
            if want and 100 * matched >= percent * sum(want.values()):
                out[i, item["item_id"]] = (matched, sum(want.values()))
    return out


def passages(rows, window):
    """{doc_id: (n_words, n_removed, sha256 of the kept words)}; ids are distinct or null."""
    first = {}
    for r in rows:
        w = words(r["text"])
        for p in range(len(w) - window + 1) if r["doc_id"] is not None else ():
            key = tuple(w[p:p + window])
            first[key] = min(first.get(key, r["doc_id"]), r["doc_id"])
    out = []
    for r in rows:
        w = words(r["text"])
        gone = [False] * len(w)
        for p in range(len(w) - window + 1) if r["doc_id"] is not None else ():
            if first[tuple(w[p:p + window])] < r["doc_id"]:
                gone[p:p + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((r["doc_id"], len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def bpe(path, pattern):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def pipeline(rows, items, encoding):
    """doc_id -> ids after all stages of corpus_pipeline."""
    rows = [r for r in rows if quality(r["text"])[-1]]
    rows = drop_lines(rows)
    component = groups(rows, 5)
    rows = [r for r in rows if r["doc_id"] is None or component[r["doc_id"]][1] == r["doc_id"]]
    bad = {d for d, _ in leaks(rows, items)}
    return {r["doc_id"]: encoding.encode_ordinary(r["text"]) for r in rows if r["doc_id"] not in bad}
