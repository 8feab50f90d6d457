"""Fixtures and plain versions that the operators are held against."""

import hashlib
import random
import re

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def docs(spark, rows, parts=3):
    """documents of (doc_id, text) with the other columns of the table."""
    full = [(i, t, "en", "src0", None if t is None else len(t)) for i, t in rows]
    return spark.createDataFrame(full, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(parts)


def table(tmp_path, name, df):
    df.write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def words(seed, n, vocabulary=300):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def base_spans(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m.group())
            good = {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m.group().split(".")), "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if good:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def removed(texts, width):
    """(bytes, removed, runs, digest) of each text by comparing all windows."""
    raws, seen = [(t or "").encode() for t in texts], {}
    for r in raws:
        for p in range(len(r) - width + 1):
            seen[r[p : p + width]] = seen.get(r[p : p + width], 0) + 1
    out = []
    for r in raws:
        gone = bytearray(len(r))
        for p in range(len(r) - width + 1):
            if seen[r[p : p + width]] > 1:
                gone[p : p + width] = b"\1" * width
        left = bytes(b for b, x in zip(r, gone, strict=True) if not x)
        out.append((len(r), sum(gone), sum(bool(gone[i]) and not (i and gone[i - 1]) for i in range(len(r))), hashlib.sha256(left).hexdigest()))
    return out


def shingle_set(text):
    w = (text or "").split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def near(rows):
    """id -> (class, links) by comparing all pairs."""
    sets, root, links = [shingle_set(t) for _, t in rows], list(range(len(rows))), [0] * len(rows)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and both >= 0.8 * len(sets[i] | sets[j]) - 1e-9:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(d, least.get(find(i), d))
    return {d: (least[find(i)], links[i]) for i, (d, _) in enumerate(rows)}
