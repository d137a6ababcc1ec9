"""Plain single-process versions of the operators, written from their contracts."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def lm(rows, mass, order=3, held=lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2):
    train = [("<s>", *words(t), None) for i, t in rows if not held(i)]
    count = [Counter(t[j : j + k] for t in train for j in range(len(t) - k + 1)) for k in range(1, order + 1)]
    start = count[0].pop(("<s>",), 0)
    n, v = sum(count[0].values()), len(count[0])

    def p(word, history):
        if not history:
            return (count[0][word,] + 1) / (n + v + 1)
        k, lower = len(history), p(word, history[1:])
        seen = start if history == ("<s>",) else count[k - 1][history]
        m = mass[min(k - 1, len(mass) - 1)]
        return (count[k][(*history, word)] + m * lower) / (seen + m) if seen else lower

    out = []
    for i, text in rows:
        t = ["<s>", *words(text), None]
        base = sum(math.log10(p(w, ())) for w in t[1:])
        score = sum(math.log10(p(t[j], tuple(t[max(0, j - order + 1) : j]))) for j in range(1, len(t)))
        out.append((i, held(i), len(t) - 1, sum(count[0][w,] > 0 for w in t[1:]), n, round(base, 6), round(score, 6)))
    return out


def repeats(rows, length):
    raw = [(t or "").encode() for _, t in rows]
    seen = Counter(r[p : p + length] for r in raw for p in range(len(r) - length + 1))
    out = []
    for (i, _), r in zip(rows, raw, strict=True):
        gone = bytearray(len(r))
        for p in range(len(r) - length + 1):
            if seen[r[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        spans = sum(1 for k in range(len(r)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(r), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(r, gone, strict=True) if not g)).hexdigest()))
    return out


def shingles(text):
    w = words(text)
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def near_duplicates(rows, percent=85):
    sets, parent = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    index = defaultdict(set)
    for k, s in enumerate(sets):
        for x in s:
            index[x].add(k)
    for k, s in enumerate(sets):
        for j in {j for x in s for j in index[x] if j > k}:
            both = len(s & sets[j])
            if 100 * both >= percent * len(s | sets[j]):
                parent[find(j)] = find(k)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    out = []
    for k, (i, _) in enumerate(rows):
        c = least.get(find(k))
        out.append((i, len(sets[k]), c, i == c))
    return out


def lines(rows, least=10):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    rank = lambda i: (i is None, i)
    owners = defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= least:
                owners[key(x)].add(rank(i))
    out = []
    for i, t in rows:
        every = (t or "").split("\n")
        kept = [x for x in every if len(key(x)) < least or len(owners[key(x)]) < 2 or min(owners[key(x)]) == rank(i)]
        out.append((i, len(every), len(every) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out


def leaks(rows, items, threshold=0.8):
    """(doc, item) pairs for which some item-sized window is similar enough, by trying every window."""
    out = set()
    for i, t in rows:
        w = WORD.findall((t or "").lower())
        for j, text in items:
            x = WORD.findall((text or "").lower())
            if not x:
                continue
            k = min(5, len(x))
            b = Counter(tuple(x[p : p + k]) for p in range(len(x) - k + 1))
            all_ = [tuple(w[p : p + k]) for p in range(len(w) - k + 1)]
            if not set(all_) & set(b):
                continue
            m = sum(b.values())
            for s in range(max(1, len(all_) - m + 1)):
                a = Counter(all_[s : s + m])
                both = sum((a & b).values())
                if both / (sum(a.values()) + m - both) >= threshold:
                    out.add((i, j))
                    break
    return out


def secrets(rows, max_owners=2, max_repos=10, alone=32):
    """(id, spans) of rows (id, text, owner): base spans, and bare ones whose value few owners and repositories hold."""
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
    kinds = ("assign", "access", "hex", "bare")
    found, owners, repos, based = [], defaultdict(set), defaultdict(set), set()
    for i, t, owner in rows:
        t = t or ""
        base = [(m.start(), 0, m.end(), m[2]) for m in assign.finditer(t) if len(m[2]) >= 6]
        base += [(m.start(), 1, m.end(), m[0]) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        base += [(m.start(), 2, m.end(), m[0]) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        bare = [(m.start(), 3, m.end(), m[0]) for m in re.finditer("[A-Za-z0-9+/_-]{20,}", t) if re.search("[A-Za-z]", m[0]) and re.search("[0-9]", m[0])]
        bare = [b for b in bare if not any(s[0] < b[2] and b[0] < s[2] for s in base)]
        for s in base + bare:
            owners[s[3]].add(owner)
            repos[s[3]].add(i)
        based |= {s[3] for s in base}
        found.append((i, base, bare))
    live = lambda v: len(owners[v]) <= max_owners and len(repos[v]) <= max_repos
    out = []
    for i, base, bare in found:
        more = [s for s in bare if live(s[3]) and (s[3] in based or len(s[3]) >= alone)]
        text = lambda spans: ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b, _ in sorted(spans))
        out.append((i, *(sum(s[1] == k for s in base) for k in range(3)), hashlib.sha256(text(base).encode()).hexdigest(), text(base + more)))
    return out


def chat(rows):
    """(conv, turn, body, reply_to, root, depth, n_quotes, n_linked, levels) of rows (conv, turn, role, text)."""
    import regex

    mark = re.compile(r"^(\s{0,3}>)+ ?")
    norm = lambda x: regex.sub(r"[^\p{L}\p{N}]+", " ", x.lower()).strip(" ")
    split, held = [], defaultdict(set)
    for c, n, _, t in rows:
        runs = []
        for raw in (t or "").split("\n"):
            m = mark.match(raw)
            level, line = (m[0].count(">"), raw[m.end() :]) if m else (0, raw)
            if runs and runs[-1][0] == level:
                runs[-1][1].append(line)
            else:
                runs.append((level, [line]))
        split.append(runs)
        for level, own in runs:
            if not level:
                for x in ["\n".join(own), *own]:
                    held[c, norm(x)].add(n)
    quoted = defaultdict(set)
    counts = []
    for (c, n, _, _), runs in zip(rows, split, strict=True):
        votes, linked = Counter(), 0
        latest = lambda x, c=c, n=n: max((k for k in held[c, norm(x)] if norm(x) and None not in (k, n, c) and k < n), default=None)
        for level, own in runs:
            if level:
                whole = latest("\n".join(own))
                hits = [whole] if whole is not None else [k for x in {norm(x): x for x in own}.values() if (k := latest(x)) is not None]
                linked += bool(hits)
                votes.update((level, k) for k in hits)
        if votes:
            quoted[c, n].add(max(((-level, v, k) for (level, k), v in votes.items()))[2])
        counts.append((sum(level > 0 for level, _ in runs), linked, max(level for level, _ in runs)))
    turns = defaultdict(set)
    for c, n, _, _ in rows:
        if c is not None and n is not None:
            turns[c].add(n)
    parent = {(c, n): max(quoted[c, n], default=None) if quoted[c, n] else max((k for k in turns[c] if k < n), default=None) for c in turns for n in turns[c]}
    out = []
    for (c, n, _, t), runs, (q, linked, levels) in zip(rows, split, counts, strict=True):
        root, depth = n, 0
        while parent.get((c, root)) is not None:
            root, depth = parent[c, root], depth + 1
        body = "\n".join("\n".join(own) for level, own in runs if not level).strip("\n") if q else t or ""
        out.append((c, n, body, parent.get((c, n)), root, depth, q, linked, levels))
    return out


def png_samples(stored):
    """Samples of an unfiltered greyscale PNG, by its format."""
    import struct

    assert stored[:8] == b"\x89PNG\r\n\x1a\n"
    at, parts, shape = 8, b"", None
    while at < len(stored):
        n, kind = struct.unpack(">I4s", stored[at : at + 8])
        body = stored[at + 8 : at + 8 + n]
        assert struct.unpack(">I", stored[at + 8 + n : at + 12 + n])[0] == zlib.crc32(kind + body)
        if kind == b"IHDR":
            shape = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            parts += body
        at += 12 + n
    width, height, depth, colour, *_ = shape
    assert (depth, colour) == (8, 0)
    lines = zlib.decompress(parts)
    assert len(lines) == height * (width + 1) and not any(lines[k * (width + 1)] for k in range(height))
    return b"".join(lines[k * (width + 1) + 1 : (k + 1) * (width + 1)] for k in range(height))


def language(text, dictionaries, piece=4096):
    """(label, margin) by the sizes of the pieces compressed with each dictionary."""
    import regex
    import zstandard

    raw = regex.sub(r"\P{L}+", " ", (text or "").lower()).strip(" ").encode()
    if not raw or not dictionaries:
        return "und", 0.0
    for strong in (False, True):
        sizes = []
        for k, d in dictionaries.items():
            data = zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            if strong:
                c = zstandard.ZstdCompressor(level=12, dict_data=data, write_checksum=False, write_content_size=False)
            else:
                shape = zstandard.ZstdCompressionParameters(window_log=17, hash_log=15, chain_log=16, search_log=3, min_match=4, strategy=zstandard.STRATEGY_GREEDY, write_content_size=False, write_checksum=False)
                data.precompute_compress(compression_params=shape)
                c = zstandard.ZstdCompressor(compression_params=shape, dict_data=data)
            sizes.append((sum(len(c.compress(raw[at : at + piece])) for at in range(0, len(raw), piece)), k))
        sizes.sort(key=lambda x: (x[0], list(dictionaries).index(x[1])))
        if len(sizes) < 2 or sizes[0][0] != sizes[1][0]:
            break
    return sizes[0][1], (sizes[1][0] - sizes[0][0]) / sizes[1][0] if len(sizes) > 1 else 1.0
