"""DuckDB SQL for the queries, in formulations of their own: windows over exploded positions and an unrolled
recursive column-by-column alignment."""

from __future__ import annotations

from ..synth import reads_sql


class Sql:
    """A WITH clause under construction."""

    def __init__(self) -> None:
        self.parts: list[str] = []
        self.n = 0

    def add(self, body: str, name: str | None = None) -> str:
        self.n += 1
        name = name or f"c{self.n}"
        self.parts.append(f"{name} AS ({body})")
        return name

    def select(self, body: str) -> str:
        return "WITH RECURSIVE " + ",\n".join(self.parts) + "\n" + body

    def reads(self, salt: str = "r1", where: str = "") -> str:
        own = reads_sql("orders", salt)
        return self.add(f"SELECT * FROM ({own}) x WHERE {where}" if where else own)

    def quality(self, src: str, cutoff: int = 20, two_colour: bool = False) -> str:
        """src with keep."""
        add = f"{cutoff} - greatest(ascii(substr(qual, n - k + 1, 1)) - 33, 0)"
        if two_colour:
            add = f"CASE WHEN substr(seq, n - k + 1, 1) = 'G' THEN 1 ELSE {add} END"
        p = self.add(f"SELECT rec_idx, seq, qual, length(qual) AS n, unnest(range(1, length(qual) + 1)) AS k FROM {src}")
        s = self.add(f"SELECT rec_idx, k, sum({add}) OVER (PARTITION BY rec_idx ORDER BY k) AS run FROM {p}")
        d = self.add(f"SELECT rec_idx, k, run, min(run) OVER (PARTITION BY rec_idx ORDER BY k) AS low FROM {s}")
        b = self.add(f"SELECT rec_idx, k, row_number() OVER (PARTITION BY rec_idx ORDER BY run DESC, k) AS rn FROM {d} WHERE low >= 0 AND run > 0")
        return self.add(f"SELECT x.*, length(qual) - coalesce(b.k, 0) AS keep FROM {src} x LEFT JOIN {b} b ON b.rec_idx = x.rec_idx AND b.rn = 1")

    def homopolymer(self, src: str, base: str, head: bool = False) -> str:
        """src with hlen."""
        at = "k" if head else "n - k + 1"
        p = self.add(f"SELECT rec_idx, seq, length(seq) AS n, unnest(range(1, length(seq) + 1)) AS k FROM {src}")
        w = "OVER (PARTITION BY rec_idx ORDER BY k)"
        hit = f"substr(seq, {at}, 1) = '{base}'"
        s = self.add(f"SELECT rec_idx, n, k, sum(CASE WHEN {hit} THEN 1 ELSE -2 END) {w} AS score, sum(CASE WHEN {hit} THEN 0 ELSE 1 END) {w} AS err FROM {p}")
        b = self.add(f"SELECT rec_idx, n, k, row_number() OVER (PARTITION BY rec_idx ORDER BY score DESC, k) AS rn FROM {s} WHERE score > 0 AND err * 5 <= k")
        return self.add(f"SELECT x.*, coalesce(b.k, 0) AS hlen FROM {src} x LEFT JOIN {b} b ON b.rec_idx = x.rec_idx AND b.rn = 1 AND b.k >= 3 AND b.n >= 3")

    def match(self, src: str, adapter: str, rate: float = 0.1, overlap: int = 1) -> str:
        """(rec_idx, read_start, read_end, overlap, errors) of the reads of src that hold the adapter."""
        m = len(adapter)
        budget = lambda n: n * round(rate * 1_000_000) // 1_000_000
        self.n += 1
        t = f"dp{self.n}"
        zero = ", ".join(f"{i} AS d{i}, 0 AS s{i}" for i in range(m + 1))
        step, names = ["0 AS n0", "j + 1 AS t0"], []
        for i in range(1, m + 1):
            sub, up, left = f"(d{i - 1} + CASE WHEN substr(seq, j + 1, 1) = '{adapter[i - 1]}' THEN 0 ELSE 1 END)", f"(n{i - 1} + 1)", f"(d{i} + 1)"
            step += [f"least({sub}, {up}, {left}) AS n{i}", f"CASE WHEN n{i} = {sub} THEN s{i - 1} WHEN n{i} = {up} THEN t{i - 1} ELSE s{i} END AS t{i}"]
        names = ", ".join(f"n{i}, t{i}" for i in range(m + 1))
        self.parts.append(
            f"{t} AS (SELECT rec_idx, seq, length(seq) AS n, 0 AS j, {zero} FROM {src} UNION ALL "
            f"SELECT rec_idx, seq, n, j1, {names} FROM (SELECT rec_idx, seq, n, CAST(j + 1 AS INTEGER) AS j1, {', '.join(step)} FROM {t} WHERE j < n))"
        )
        full = self.add(f"SELECT rec_idx, n, j, d{m} AS e, s{m} AS s, row_number() OVER (PARTITION BY rec_idx ORDER BY j) AS rn FROM {t} WHERE j > 0 AND d{m} <= {budget(m)}")
        f = self.add(
            f"SELECT f.rec_idx, f.s, CASE WHEN x.d{m} <= f.e THEN f.s + {m} ELSE f.j END AS stop, CASE WHEN x.d{m} <= {budget(m)} THEN least(x.d{m}, f.e) ELSE f.e END AS e "
            f"FROM {full} f LEFT JOIN {t} x ON x.rec_idx = f.rec_idx AND x.j = f.s + {m} WHERE f.rn = 1"
        )
        cases = " ".join(f"WHEN n >= {i} AND d{i} <= {budget(i)} THEN {i}" for i in range(m, overlap - 1, -1))
        pick = lambda c: "CASE o " + " ".join(f"WHEN {i} THEN {c}{i}" for i in range(1, m + 1)) + " END"
        p0 = self.add(f"SELECT *, CASE {cases} END AS o FROM {t} WHERE j = n AND n > 0")
        p = self.add(f"SELECT rec_idx, n, o, {pick('s')} AS s, {pick('d')} AS e FROM {p0} WHERE o IS NOT NULL")
        use = "(p.s IS NULL OR f.s <= p.s) AND f.s IS NOT NULL"
        return self.add(
            f"SELECT coalesce(f.rec_idx, p.rec_idx) AS rec_idx, CASE WHEN {use} THEN f.s ELSE p.s END AS read_start, CASE WHEN {use} THEN f.stop ELSE p.n END AS read_end, "
            f"CASE WHEN {use} THEN {m} ELSE p.o END AS overlap, CASE WHEN {use} THEN f.e ELSE p.e END AS errors FROM {f} f FULL JOIN {p} p ON p.rec_idx = f.rec_idx"
        )

    def cut(self, src: str, adapters: list[str], rate: float = 0.1, overlap: int = 1) -> str:
        """src with its reads cut at the best match, and adapter_idx and removed (null without a match)."""
        each = [f"SELECT rec_idx, read_start, {k} AS adapter_idx FROM {self.match(src, a, rate, overlap)}" for k, a in enumerate(adapters)]
        b = self.add(f"SELECT *, row_number() OVER (PARTITION BY rec_idx ORDER BY read_start, adapter_idx) AS rn FROM ({' UNION ALL '.join(each)})")
        return self.add(
            f"SELECT x.rec_idx, x.id, CASE WHEN b.rn IS NULL THEN x.seq ELSE substr(x.seq, 1, b.read_start) END AS seq, CASE WHEN b.rn IS NULL THEN x.qual ELSE substr(x.qual, 1, b.read_start) END AS qual, "
            f"b.adapter_idx, length(x.seq) - b.read_start AS removed FROM {src} x LEFT JOIN {b} b ON b.rec_idx = x.rec_idx AND b.rn = 1"
        )

    def trimmed(self, src: str, adapters: list[str], cutoff: int = 20) -> str:
        """Quality, then adapter trimming: (rec_idx, id, seq, qual, n0, quality_bp, adapter_idx, removed)."""
        q = self.quality(src, cutoff)
        s = self.add(f"SELECT rec_idx, id, substr(seq, 1, keep) AS seq, substr(qual, 1, keep) AS qual FROM {q}")
        c = self.cut(s, adapters)
        return self.add(f"SELECT c.*, length(q.seq) AS n0, length(q.seq) - q.keep AS quality_bp FROM {c} c JOIN {q} q ON q.rec_idx = c.rec_idx")


def n_count(seq: str = "seq") -> str:
    return f"(length({seq}) - length(translate({seq}, 'Nn', '')))"


def big(x: str, name: str) -> str:
    return f"CAST({x} AS BIGINT) AS {name}"
