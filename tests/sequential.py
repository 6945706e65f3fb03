"""The filing rules as plain loops, for tests."""

from collections import Counter

LOST = ("failed", "", None)


def valid(job):
    return bool(job) and job not in ("failed", "bad")


def base(job):
    return job.split("-")[0] if valid(job) else None


def file_batch(rows, known=()):
    """rows: (scan_idx, raw_job, confidence) in order; the corrected jobs."""
    raw = [r[1] for r in rows]
    new = [None if r[1] in LOST else r[1] for r in rows]
    why = [""] * len(rows)

    def job(i):
        return new[i] or raw[i]

    for i in range(1, len(rows) - 1):
        before, now, after = job(i - 1), job(i), job(i + 1)
        if before in LOST or after in LOST or before != after or now == before or now in known:
            continue
        if valid(now) and base(now) == base(before):
            a, b = (j.split("-")[1] if "-" in j else None for j in (now, before))
            typo = a and b and len(a) == len(b) and sum(x != y for x, y in zip(a, b, strict=True)) == 1
            if not typo and rows[i][2] >= 0.75:
                why[i] = "kept"
                continue
        if abs(rows[i][0] - rows[i - 1][0]) <= 1 and abs(rows[i + 1][0] - rows[i][0]) <= 1:
            new[i], why[i] = before, "Tier 1"
    for i in range(len(rows)):
        if job(i) in known or not valid(job(i)) or "-" in job(i):
            continue
        for n in (i - 1, i + 1):
            if 0 <= n < len(rows) and valid(job(n)) and "-" in job(n) and base(job(n)) == base(job(i)):
                new[i], why[i] = job(n), "Tier 2"
                break
    for i in range(len(rows)):
        if valid(job(i)) or job(i) in known:
            continue
        frame = range(max(0, i - 2), min(len(rows), i + 3))
        bases = Counter(base(job(n)) for n in frame if valid(job(n)))
        major = bases.most_common(1)[0][0] if bases else None
        votes = Counter()
        for n in frame:
            far = abs(rows[n][0] - rows[i][0])
            if n == i or far > 2 or not valid(job(n)) or (rows[n][2] < 0.7 and "Tier" not in why[n]):
                continue
            weight = (3 - abs(i - n)) * (1 if far <= 1 else 0.3)
            votes[job(n)] += weight * (0.1 if base(job(n)) != major else 1)
        if votes:
            new[i], why[i] = votes.most_common(1)[0][0], "Tier 3"
    return [new[i] or raw[i] for i in range(len(rows))]
