"""Plain scalar models of the read operators."""


def quality_keep(qual, cutoff, offset=33, seq=None):
    run = best = 0
    keep = len(qual)
    for i in range(len(qual) - 1, -1, -1):
        run += 1 if seq is not None and seq[i] == "G" else cutoff - max(ord(qual[i]) - offset, 0)
        if run < 0:
            break
        if run > best:
            best, keep = run, i
    return keep


def homopolymer(seq, base, head=False):
    s = seq if head else seq[::-1]
    score = errors = best = at = 0
    for k, c in enumerate(s, 1):
        score += 1 if c == base else -2
        errors += c != base
        if score > best and errors * 5 <= k:
            best, at = score, k
    return at if at >= 3 and len(seq) >= 3 else 0


def align(read, adapter, rate, overlap):
    """Full matrix and backtrace."""
    n, m = len(read), len(adapter)
    if not n or not m or overlap < 1:
        return None
    d = [[0] * (n + 1) for _ in range(m + 1)]
    for i in range(1, m + 1):
        d[i][0] = i
        for j in range(1, n + 1):
            d[i][j] = min(d[i - 1][j - 1] + (adapter[i - 1] != read[j - 1]), d[i - 1][j] + 1, d[i][j - 1] + 1)

    def start(i, j):
        while i:
            if j and d[i][j] == d[i - 1][j - 1] + (adapter[i - 1] != read[j - 1]):
                i, j = i - 1, j - 1
            elif d[i][j] == d[i - 1][j] + 1:
                i -= 1
            else:
                j -= 1
        return j

    budget = lambda k: k * round(rate * 1_000_000) // 1_000_000
    full = part = None
    for j in range(1, n + 1):
        if d[m][j] <= budget(m):
            s = start(m, j)
            e = s + m
            fits = e <= n
            err = min(d[m][e], d[m][j]) if fits and d[m][e] <= budget(m) else d[m][j]
            full = (s, e if fits and d[m][e] <= d[m][j] else j, m, err)
            break
    for i in range(min(m, n), overlap - 1, -1):
        if d[i][n] <= budget(i):
            part = (start(i, n), n, i, d[i][n])
            break
    if full and part:
        return full if full[0] <= part[0] else part
    return full or part


def minimizer(seq, k=16):
    s = "".join(c if c in "ACGT" else "A" for c in seq.upper()).ljust(k, "A")
    code = lambda w, t: int("".join(t["ACGT".index(c)] for c in w), 4)
    return min(min(code(s[i : i + k], "0123"), code(s[i : i + k][::-1], "3210")) for i in range(len(s) - k + 1))


def fnv_bin(key, bins):
    h = 0x811C9DC5
    for b in key.to_bytes(4, "big"):
        h = (h ^ b) * 0x01000193 & 0xFFFFFFFF
    return h % bins
