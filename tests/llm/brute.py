"""Plain Python versions of the operators."""

import re
from collections import Counter, defaultdict

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SPACE = " \t\n\x0b\x0c\r"


def shingles(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return set()
    return {tuple(words)} if len(words) < 5 else {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def component_ids(rows):
    """component_id of each (key, doc_id, text), in order."""
    sets = [shingles(text) for _, text in rows]
    roots = list(range(len(rows)))

    def find(i):
        while roots[i] != i:
            i = roots[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 80 * len(sets[a] | sets[b]):
                roots[find(a)] = find(b)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(i)] = min(doc_id, least.get(find(i), doc_id))
    return [least.get(find(i)) if sets[i] else rows[i][0] for i in range(len(rows))]


def statistics(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines."""
    text = text or ""
    words = WORD.findall(text)
    lines = [line for line in text.split("\n") if WORD.search(line)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    times = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(8)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), len(lines)


def without_repeated_lines(rows):
    """Texts of distinct (doc_id, text) rows after line dedup, keyed by the row."""
    places = defaultdict(list)
    for doc_id, text in sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0)):
        if text is None:
            continue
        full = [(i, line.strip(SPACE)) for i, line in enumerate(text.split("\n")) if line.strip(SPACE)]
        for j in range(len(full) - 2):
            places[tuple(line for _, line in full[j : j + 3])].append(((doc_id, text), full[j][0], full[j + 2][0]))
    gone = defaultdict(set)
    for found in places.values():
        for row, a, b in found[1:]:
            gone[row].update(range(a, b + 1))
    return {row: None if row[1] is None else "\n".join(line for i, line in enumerate(row[1].split("\n")) if i not in gone[row]) for row in set(rows)}


def determinant_distances(x, unit, least, bins, part, steps):
    """Squared distances of one group's fixed-point vectors by the same concentration steps, with numpy."""
    p = x.shape[1]
    v = x / unit

    def factor(cov):
        return cov + np.diag(np.square(least))

    quartile = np.percentile(v, [25, 50, 75], axis=0)
    starts = [(quartile[1], factor(np.diag(((quartile[2] - quartile[0]) / 1.349) ** 2))), (v.mean(axis=0), factor(np.cov(v.T, bias=True).reshape(p, p)))]
    ends = []
    for centre, matrix in starts:
        for _ in range(steps):
            d = np.einsum("ij,jk,ik->i", v - centre, np.linalg.inv(matrix), v - centre)
            bin_ = np.floor(np.log(np.maximum(d, 1e-6)) * bins)
            edge = next(b for b in np.unique(bin_) if (bin_ <= b).sum() >= part * len(v))
            chosen = v[bin_ <= edge]
            centre, matrix = chosen.mean(axis=0), factor(np.cov(chosen.T, bias=True).reshape(p, p))
        ends.append((np.linalg.det(matrix), centre, matrix))
    _, centre, matrix = min(ends, key=lambda e: e[0])
    return np.einsum("ij,jk,ik->i", v - centre, np.linalg.inv(matrix), v - centre)
