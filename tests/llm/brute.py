"""Plain Python versions of the operators, for small tables."""
import hashlib
import math
import re
import zlib
from collections import Counter

import xxhash

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def words(text, lower=False):
    raw = (text or "").encode()
    return WORD.findall(bytes(c + 32 if 65 <= c <= 90 else c for c in raw) if lower else raw)


def crc(i):
    return zlib.crc32(str(i).encode())


def components(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def repeats(rows):
    """{doc_id: (n_words, n_removed, kept sha256, kept text)} of (doc_id, text) rows with distinct ids."""
    docs = sorted((i, words(t)) for i, t in rows)
    first, out = {}, {}
    for i, w in docs:
        for k in range(len(w) - 12):
            first.setdefault(b" ".join(w[k:k + 13]), i)
    for i, w in docs:
        gone = set()
        for k in range(len(w) - 12):
            if first[b" ".join(w[k:k + 13])] < i:
                gone.update(range(k, k + 13))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept).hexdigest(), kept.decode())
    return out


def fingerprint(text):
    w = words(text, lower=True)
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[k:k + 3]), 42) for k in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))


def simhash(rows):
    fp = {i: fingerprint(t) for i, t in rows}
    ids = sorted(fp)
    links = [(a, b) for n, a in enumerate(ids) for b in ids[n + 1:] if (fp[a] ^ fp[b]).bit_count() <= 3]
    return fp, components(ids, links)


def kneser_ney(train, texts):
    """(n_tokens, n_known, N, base, score) per text."""
    toks = lambda t: words(t, lower=True) + [b"\n"]
    uni, pair = Counter(), Counter()
    for t in train:
        w = toks(t)
        uni.update(w)
        pair.update(zip([b"\n", *w], w))
    n, v = sum(uni.values()), len(uni)

    def discounts(counts):
        t = [sum(1 for c in counts if c == k) for k in range(1, 5)]
        if not (t[0] and t[1]):
            return [0.5, 1.0, 1.5]
        y = t[0] / (t[0] + 2 * t[1])
        d = [1 - 2 * y * t[1] / t[0], 2 - 3 * y * t[2] / t[1]]
        d.append(3 - 4 * y * t[3] / t[2] if t[2] else d[1])
        return [min(max(x, 0.0), k) for k, x in enumerate(d, 1)]

    left = Counter(x for _, x in pair)
    dp, dl = discounts(pair.values()), discounts(left.values())
    cut = lambda c, d: max(c - (d[min(c, 3) - 1] if c else 0), 0)
    rest = sum(dl[min(c, 3) - 1] for c in left.values()) / len(pair) if pair else 1.0
    total, share = Counter(), Counter()
    for (h, _), c in pair.items():
        total[h] += c
        share[h] += dp[min(c, 3) - 1]

    def p(h, x):
        low = cut(left[x], dl) / max(len(pair), 1) + rest / (v + 1)
        return cut(pair[h, x], dp) / total[h] + share[h] / total[h] * low if total[h] else low

    out = []
    for t in texts:
        w = toks(t)
        out.append((len(w), sum(uni[x] > 0 for x in w), n, sum(math.log10((uni[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w),
                    sum(math.log10(p(h, x)) for h, x in zip([b"\n", *w], w))))
    return out


def trie(rows, shared=None):
    """Nodes of (conv_id, turn, role, text) rows, as sorted tuples."""
    turns = {}
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            digest = hashlib.md5(f"{len(r)} {r} {x}".encode()).hexdigest()  # equal turns go by it
            turns.setdefault(c, []).append((t is not None, t or 0, digest, r, x))
    turns = {c: [(r, x) for *_, r, x in sorted(v)] for c, v in turns.items()}
    built = {}
    for c, own in turns.items():
        h = shared(c) if shared else crc(c) % 6
        built[c] = turns.get(c - int(math.fmod(c, 100)), [])[:h] + own[h:]
    members = {}
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            members.setdefault(tuple(built[c][:d]), []).append(c)
    out = {p: {"children": 0, "leaves": 0, "saved": 0} for p in members}
    for p in members:
        if p:
            out[p[:-1]]["children"] += 1
    for p, m in members.items():
        for d in range(len(p) + 1):
            out[p[:d]]["leaves"] += out[p]["children"] == 0
            out[p[:d]]["saved"] += (len(m) - 1) * len(p[-1][1]) if p else 0
    return sorted((m[0], len(p), members[p[:-1]][0] if p else -1, len(m), out[p]["children"], out[p]["leaves"], out[p]["saved"],
                   hashlib.sha256(",".join(str(c) for c in m if len(built[c]) == len(p)).encode()).hexdigest()) for p, m in members.items())


def alignment(texts, encode_a, bytes_a, encode_b, bytes_b):
    """(n_a, n_b, n_groups, n_links, n_best, count_sum, groups sha256) of each text."""
    links, out = [], []
    for t in texts:
        a, b = (encode_a(" " + t), encode_b(t)) if t else ([], [])
        want = b" " + (t or "").encode()
        if not t or b"".join(map(bytes_a, a)) != want or b"".join(map(bytes_b, b)) != want:
            links.append([])
            out.append((0, 0, 0, ""))
            continue
        spans = []
        for ids, of in ((a, bytes_a), (b, bytes_b)):
            at, own = 0, []
            for i in ids:
                own.append((at, at + len(of(i)), i))
                at += len(of(i))
            spans.append(own)
        links.append([(x[2], y[2]) for x in spans[0] for y in spans[1] if x[0] < y[1] and y[0] < x[1]])
        stops = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        groups = [[[i for s, e, i in own if lo <= s and e <= hi] for own in spans] for lo, hi in zip([0, *stops], stops)]
        text = ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)
        out.append((len(a), len(b), len(groups), hashlib.sha256(text.encode()).hexdigest()))
    count = Counter(p for own in links for p in own)
    top = Counter()
    for (_, b), c in count.items():
        top[b] = max(top[b], c)
    return [(n_a, n_b, g, len(own), sum(count[p] == top[p[1]] for p in own), sum(count[p] for p in own), h)
            for (n_a, n_b, g, h), own in zip(out, links)]


def quality(text, model, hash_of):
    """(score, number of passages, largest attention) of a text, word by word and passage by passage."""
    classes = [b"#*$%&|<>{}[]\\^~_=+@", b"!", bytes(range(65, 91)), b"0123456789", b".?!", bytes(range(128, 256)), b"/:;,()\"'"]
    all_words = words(text)
    lower = [w.lower() for w in all_words]
    rows = []
    for a in range(0, max(len(all_words), 1), 64):
        own = all_words[a:a + 64]
        if not own:
            rows.append([1.0] + [0.0] * 17)
            continue
        n, size = len(own), sum(map(len, own))
        odds = [float(model.lexicon[hash_of(w)]) for w in lower[a:a + 64]]
        row = [0.0, math.log1p(n) / 4, size / n / 8]
        row += [math.log1p(8 * sum(c in cl for w in own for c in w) / size) for cl in classes]
        row.append(sum(k > 0 and lower[k] == lower[k - 1] for k in range(a, a + n)) / n)
        row.append(sum(lower[k] in lower[a:k] for k in range(a, a + n)) / n)
        row.append(sum(lower[k] in lower[:k] for k in range(a, a + n)) / n)
        row += [sum(odds) / n, min(odds) / 4, max(odds) / 4, sum(min(o, 0.0) for o in odds) / 8, math.log1p(len(all_words)) / 8]
        rows.append(row)
    w, energies, hidden = model.weights, [], []
    for row in rows:
        x = [(v - m) / s for v, m, s in zip(row, model.mean, model.scale)]
        h = [max(sum(x[i] * w["W"][i, k] for i in range(len(x))) + w["w0"][k], 0.0) for k in range(len(w["w0"]))]
        gates = range(len(w["a"]))
        t = [math.tanh(sum(h[i] * w["V"][i, k] for i in range(len(h)))) for k in gates]
        g = [1 / (1 + math.exp(-sum(h[i] * w["U"][i, k] for i in range(len(h))))) for k in gates]
        energies.append(sum(t[k] * g[k] * w["a"][k] for k in gates))
        hidden.append(h)
    e = [math.exp(v - max(energies)) for v in energies]
    attention = [v / sum(e) for v in e]
    z = [sum(a * h[k] for a, h in zip(attention, hidden)) for k in range(len(w["c"]))]
    return 1 / (1 + math.exp(-sum(v * c for v, c in zip(z, w["c"])) - float(w["c0"][0]))), len(rows), max(attention)
