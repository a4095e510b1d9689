"""Plain per-episode restatements used as brute-force checks."""

import itertools
import random


def iou(a, b):
    both = max(0.0, min(a[1], b[1]) - max(a[0], b[0]))
    total = (a[1] - a[0]) + (b[1] - b[0]) - both
    return both / total if total > 0 else 0.0


def match(pred, gold, least):
    ranked = sorted(((-iou(p, g), i, j) for i, p in enumerate(pred) for j, g in enumerate(gold)))
    free_p, free_g, taken = set(range(len(pred))), set(range(len(gold))), []
    for score, i, j in ranked:
        if -score >= least and i in free_p and j in free_g:
            free_p.discard(i), free_g.discard(j)
            taken.append((i, j))
    return sorted(taken)


def boundaries(spans):
    kept = []
    for left, right in zip(spans, spans[1:]):
        t = (left[1] + right[0]) / 2
        if not kept or abs(t - kept[-1]) > 1e-6:
            kept.append(t)
    return kept


def stitched(rows):
    out = []
    for s, e, label in sorted(rows, key=lambda r: r[:2]):
        if out and out[-1][2].strip().lower() == label.strip().lower() and s <= out[-1][1] + 1e-6:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e, label])
    return [tuple(r) for r in out]


def trimmed(rows, least=0.15):
    """Overlap trimming and gap closing on (start, end) rows already in order."""
    out = []
    for s, e in rows:
        if out and s < out[-1][1]:
            out[-1][1] = s
            if out[-1][1] - out[-1][0] < least:
                out.pop()
        out.append([s, e])
    for a, b in zip(out, out[1:]):
        if b[0] > a[1]:
            a[1] = b[0] = round((a[1] + b[0]) / 2, 2)
    return [tuple(r) for r in out]


def smoothed(labels):
    """Repeatedly absorb single frames, left neighbour first."""
    out = list(labels)
    if len(out) < 3:
        return out
    while True:
        runs = [[i for i, _ in run] for _, run in itertools.groupby(enumerate(out), key=lambda x: x[1])]
        alone = [run[0] for run in runs if len(run) == 1]
        if len(runs) == 1 or not alone:
            return out
        out[alone[0]] = out[alone[0] - 1] if alone[0] else out[1]


def random_spans(rng: random.Random, n, disjoint=False):
    t, out = 0.0, []
    for _ in range(n):
        start = t + rng.choice([0, 0, 0.5, 1]) if disjoint else rng.randrange(0, 60) / 2
        end = start + rng.choice([0.5, 1, 2, 4.5])
        out.append((start, end))
        t = end
    return out if disjoint else sorted(out)
