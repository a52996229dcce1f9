"""Plain, slow versions of the operators, for small inputs."""

import base64
import hashlib
import re
import zlib

import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

SEPARATED = re.compile(r"[^\x20\x09-\x0D]+")
BENCH_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def repeats(rows, length=50):
    """rows: (doc_id, text)."""
    first = {}
    far = 1 << 62
    for i, t in rows:
        raw = (t or "").encode()
        for k in range(len(raw) - length + 1):
            w = raw[k:k + length]
            first[w] = min(first.get(w, far), far if i is None else i)
    out = []
    for i, t in rows:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for k in range(len(raw) - length + 1):
            if first[raw[k:k + length]] < (far if i is None else i):
                gone[k:k + length] = b"\1" * length
        runs = len(re.findall(b"\1+", bytes(gone)))
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out.append((i, len(raw), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def base_quality(text):
    text = text or ""
    words = SEPARATED.findall(text)
    symbols = sum(c in "#*$%&|<>" for c in text)
    lines, dup, seen = text.split("\n"), 0, set()
    for line in lines:
        if SEPARATED.search(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[k:k + 5]) for k in range(len(words) - 4)]
    hit = set()
    for k, w in enumerate(windows):
        if windows.count(w) > 1:
            hit.update(range(k, k + 5))
    failed = len(words) < 10 or 100 * len(hit) > 20 * len(words)
    return len(words), sum(map(len, words)), symbols, dup, len(hit), failed


def shingles(text, size=5):
    words = SEPARATED.findall((text or "").translate(AZ))
    if not words:
        return set()
    if len(words) < size:
        return {tuple(words)}
    return {tuple(words[k:k + size]) for k in range(len(words) - size + 1)}


def near_duplicates(rows, percent=75):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    root[find(a)] = find(b)
    groups = {}
    for k, (i, _) in enumerate(rows):
        groups.setdefault(find(k), []).append(i)
    least = {g: min((i for i in ids if i is not None), default=None) for g, ids in groups.items()}
    return [(i, len(sets[k]), least[find(k)] if sets[k] else i) for k, (i, _) in enumerate(rows)]


def sentencepiece_rows(rows):
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    out = []
    for i, t in rows:
        ids = library.encode(t or "")
        decoded = library.decode(ids) if ids else ""
        out.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    return out


def warc_rows(rows, least=0):
    """rows: (page_id, html) without ties."""
    payloads = [(i, (h or "").encode()) for i, h in rows]
    first = {}
    for i, p in payloads:
        if i is not None and len(p) >= least:
            first[p] = min(first.get(p, i), i)
    return [(i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), *(("response", None) if i is None or first.get(p, i) == i else ("revisit", first[p]))) for i, p in payloads]


def token_rows(rows, end_id=2):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out, start = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, end_id]
        out.append((i, start, len(ids), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids))))
        start += len(ids)
    return out


PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def personal_data(text):
    """Base spans in the order of the contract."""
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text or "", re.A):
            digits = re.sub("[^0-9]", "", m[0])
            good = (kind == "email" or kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")) or kind == "card" and 13 <= len(digits) <= 19 and luhn(digits)
                    or kind == "phone" and 9 <= len(digits) <= 15)
            if good:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def contamination(rows, items, size=10):
    windows = {}
    for item, t in items:
        words = BENCH_WORD.findall((t or "").translate(AZ))
        if words:
            for k in range(max(1, len(words) - size + 1)):
                windows.setdefault(tuple(words[k:k + size]), set()).add(item)
    lengths = {len(w) for w in windows}
    out = []
    for i, t in rows:
        words = BENCH_WORD.findall((t or "").translate(AZ))
        hit, found = set(), set()
        for n in lengths:
            for k in range(len(words) - n + 1):
                w = tuple(words[k:k + n])
                if w in windows:
                    hit.update(range(k, k + n))
                    found |= windows[w]
        named = sorted(str(x) for x in found if x is not None)
        out.append((i, len(words), len(hit), len(named), hashlib.sha256(",".join(named).encode()).hexdigest(), bool(hit)))
    return out


def line_rows(rows, least_chars=20, least_docs=3):
    """(doc_id, lines, dropped, sha256 of the rest); rows without a key are one document, smaller than all."""
    far = -(1 << 63)
    holders = {}
    split = [(i, (t or "").split("\n")) for i, t in rows]
    keys = [[line.strip(" \t\n\v\f\r").translate(AZ) for line in lines] for _, lines in split]
    for (i, _), own in zip(split, keys):
        for k in own:
            if len(k) >= least_chars:
                holders.setdefault(k, set()).add(far if i is None else i)
    out = []
    for (i, lines), own in zip(split, keys):
        kept = [line for line, k in zip(lines, own) if len(holders.get(k, ())) < least_docs or max(holders[k]) == (far if i is None else i)]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out


def damage(rows):
    """rows: (conv_id, turn, role, text) -> the rows that are left, nulls as a space."""
    out = []
    for conv, turn, role, text in rows:
        name, role, text = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}", " " if role is None else role, " " if text is None else text
        lot = zlib.crc32(name.encode()) % 20
        text = "" if lot == 1 else re.sub("[.!?]", "", text) if lot == 2 else text
        role = "user" if lot == 4 else role
        out += [(conv, turn, role, text)] * (0 if lot == 0 else 2 if lot == 3 else 1)
    return out


def repaired(rows):
    """One conversation's rows (turn, role, text): numbers, audit and repaired rows, by trying all edits from left to right."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.md5(f"{len(r[1])}:{r[1]}{r[2]}".encode()).hexdigest()))
    faults, seen = [], set()
    for _, role, text in rows:
        bare = text.strip(" \t\n\v\f\r")
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    grammar = re.compile("(s?(ua)+)?")
    # (initials, audit) reachable, by least (cost, audit)
    best = {("", ()): (0, "")}

    def legal_start(x):
        return not x or re.fullmatch("s?(ua)*u?", x)

    def short(x):
        """Roles that may follow ``x`` may follow this too."""
        return x if x in ("", "s") else "u" if x.endswith("u") else "ua"

    def insert(found):
        todo = list(found.items())
        while todo:
            (x, lines), (cost, audit) = todo.pop()
            for role in ("user", "assistant"):
                y, new = x + role[0], (cost + 2, audit + "I")
                if legal_start(y):
                    place = (short(y), (*lines, (role, "")))
                    if min((v for (z, _), v in found.items() if z == place[0]), default=(1 << 60, "")) > new:
                        for other in [o for o in found if o[0] == place[0]]:
                            del found[other]
                        found[place] = new
                        todo.append((place, new))
        return found

    for (_, role, text), fault in zip(rows, faults):
        after = {}
        for (x, lines), (cost, audit) in insert(best).items():
            options = [(x, lines, cost + 3, "D")]
            if fault not in ("blank", "duplicate"):
                extra = fault == "truncated"
                options += [(x + role[:1], (*lines, (role, text)), cost + extra, "K")] if role else []
                options += [(x + new[0], (*lines, (new, text)), cost + 2 + extra, "R") for new in ("user", "assistant")]
            for y, kept, spent, letter in options:
                if legal_start(y):
                    place, value = (short(y), kept), (spent, audit + letter)
                    rivals = [o for o in after if o[0] == place[0]]
                    if not rivals or value < after[rivals[0]]:
                        for o in rivals:
                            del after[o]
                        after[place] = value
        best = after
    cost, audit, lines = min((v[0], v[1], kept) for (x, kept), v in insert(best).items() if grammar.fullmatch(x))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    pairs = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), pairs, cost, audit, lines


def repair_rows(rows, keys):
    groups = {k: [] for k in keys}
    for conv, *rest in rows:
        groups[conv].append(tuple(rest))
    return [(k, *found[:-1], hashlib.sha256("\n".join(f"{r}:{t}" for r, t in found[-1]).encode()).hexdigest()) for k, found in ((k, repaired(g)) for k, g in groups.items())]


def link_rows(rows):
    """Groups by walking over both token lists, counts by a dictionary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {**{chr(b): b for b in plain}, **{chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}}
    a_side, b_side = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    a_side.encode_special_tokens = True
    out, links = [], []
    for i, t in rows:
        own, groups, n_a, n_b = [], [], 0, 0
        if t:
            a = [(k, bytes(letters[c] for c in a_side.id_to_token(k))) for k in a_side.encode(" " + t, add_special_tokens=False).ids]
            b = [(k, bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode()) for k in b_side.encode(t) for p in [b_side.id_to_piece(k)]]
            whole = (" " + t).encode()
            if b"".join(x for _, x in a) == whole and b"".join(x for _, x in b) == whole:
                n_a, n_b = len(a), len(b)
                x = y = 0
                left, right = [], []
                for k, raw in a:
                    x += len(raw)
                    left.append(k)
                    while y < x:
                        k, raw = b[0]
                        b = b[1:]
                        y += len(raw)
                        right.append(k)
                    if x == y:
                        groups.append((left, right))
                        own.append((left[-1], right[-1]))
                        left, right = [], []
        written = ";".join(f"{','.join(map(str, p))}|{','.join(map(str, q))}" for p, q in groups)
        out.append((i, n_a, n_b, len(groups), written))
        links.append(own)
    counts = {}
    for own in links:
        for pair in own:
            counts[pair] = counts.get(pair, 0) + 1
    most = {}
    for (_, q), n in counts.items():
        most[q] = max(most.get(q, 0), n)
    return [(i, n_a, n_b, n, n, sum(counts[p] == most[p[1]] for p in own), sum(counts[p] for p in own), hashlib.sha256(w.encode()).hexdigest() if w else "") for (i, n_a, n_b, n, w), own in zip(out, links)]
