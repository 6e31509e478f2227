"""Texts that do not read as the language found for them: letter junk, and languages without labelled rows.

A language's profile gives each letter a probability after the two bytes before it. A text is familiar if the mean
log probability of its letters reaches a cutoff of its language and its number of letters. Cutoffs are set on labelled
documents that the profile has not seen, against the same documents with their letters shuffled and against those of the
other languages, so the rule does not depend on how many languages there are.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Bytes by kind: 0 for all that is not a letter, then a-z without case, then each byte that is not ASCII.
SYMBOL = np.zeros(256, np.int64)
SYMBOL[65:91] = SYMBOL[97:123] = np.arange(1, 27)
SYMBOL[128:] = np.arange(27, 155)
KINDS = 155
SLOTS = 1 << 17
#: Weight of the shorter context, in letters seen.
PRIOR = 4.0
#: Cutoffs are set for these numbers of letters.
LENGTHS = (4, 8, 16, 32, 64, 128)
#: A language with fewer labelled documents has lax cutoffs: see ``_lax_cutoff``.
LEAST_DOCS = 10
#: A language with less than this part of the documents of the most common one is a seldom one.
SELDOM = 1 / 8
FOLDS = 3
#: Losing all own documents counts as much as letting through so many times all shuffled or foreign ones.
OWN_WEIGHT = 4
CHUNK = 1 << 19


def contexts(data: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each byte its slot of three kinds, its pair and the pair before it; texts start at the positions ``first``."""
    c = SYMBOL[data]
    b, a = np.zeros_like(c), np.zeros_like(c)
    b[1:], a[2:] = c[:-1], c[:-2]
    b[first] = 0
    a[b == 0] = 0
    second = first + 1
    a[second[second < len(c)]] = 0
    pair, before = b * KINDS + c, a * KINDS + b
    return ((before * KINDS + c) * 0x9E3779B1 >> 7) % SLOTS, pair, before


@dataclass
class Profile:
    """Counts of one language, as float32: letters by slot, mass of the shorter context by pair, seen by pair before."""

    three: np.ndarray
    shorter: np.ndarray
    seen: np.ndarray

    def logs(self, slot: np.ndarray, pair: np.ndarray, before: np.ndarray) -> np.ndarray:
        return np.log(self.three[slot] + self.shorter[pair]) - np.log(self.seen[before])


def profile(texts: list[bytes]) -> Profile:
    three, two, seen = np.zeros(SLOTS), np.zeros(KINDS * KINDS), np.zeros(KINDS * KINDS)
    if texts:
        data = np.frombuffer(b"".join(texts), np.uint8)
        sizes = np.array([len(t) for t in texts])
        slot, pair, before = contexts(data, (np.cumsum(sizes) - sizes)[sizes > 0])
        letter = SYMBOL[data] > 0
        three = np.bincount(slot[letter], minlength=SLOTS)
        two = np.bincount(pair[letter], minlength=KINDS * KINDS)
        seen = np.bincount(before[letter], minlength=KINDS * KINDS)
    grid = two.reshape(KINDS, KINDS)
    one = (grid.sum(axis=0) + 0.5) / (grid.sum() + 0.5 * KINDS)
    shorter = PRIOR * (grid + PRIOR * one) / (grid.sum(axis=1, keepdims=True) + PRIOR)
    return Profile(*(np.asarray(x, np.float32) for x in (three, shorter.ravel(), seen + PRIOR)))


def letter_logs(found: Profile, text: bytes) -> np.ndarray:
    data = np.frombuffer(text, np.uint8)
    return found.logs(*contexts(data, np.zeros(min(1, len(data)), int)))[SYMBOL[data] > 0]


def shuffled(text: bytes, random: np.random.Generator) -> bytes:
    """The letters of a text in another order; all else stays in place."""
    chars = np.array(list(text.decode("utf-8", "ignore")))
    letters = np.flatnonzero([c.isalpha() for c in chars])
    chars[letters] = chars[random.permutation(letters)]
    return "".join(chars).encode()


def cutoff(own: np.ndarray, *others: np.ndarray) -> float:
    """Highest of the cutoffs that tell ``own`` from the others best, moved a quarter of the way to the next lower other."""
    own = np.sort(own)
    wrong = OWN_WEIGHT * np.arange(len(own)) / len(own)
    others = [np.sort(o) for o in others if len(o)]
    for o in others:
        wrong = wrong + 1 - np.searchsorted(o, own, "left") / len(o)
    at = own[np.flatnonzero(wrong <= wrong.min() + 1e-12)[-1]]
    below = np.concatenate([o[o < at] for o in others]) if others else np.zeros(0)
    return float(at - 0.25 * (at - below.max())) if len(below) else float(at)


def _lax_cutoff(texts: list[bytes], others: list[bytes], random: np.random.Generator) -> float:
    """Cutoff of a language with few texts: just above the highest shuffled or foreign text below all of its own.

    Each own text is read by the profile of the others, a single one by that of its other half. A language with
    too little text for that keeps all texts found to be in it.
    """
    if len(texts) == 1:
        middle = texts[0].find(b" ", len(texts[0]) // 2)
        texts = [texts[0][:middle], texts[0][middle:]] if middle > 0 else texts
    own, below = [], []
    for k, text in enumerate(texts):
        unseen = profile(texts[:k] + texts[k + 1 :])
        for found, scored in ((own, [text]), (below, [shuffled(text, random), *others[k :: len(texts)]])):
            found += [logs.mean() for t in scored if len(logs := letter_logs(unseen, t)) >= LENGTHS[0]]
    if len(own) < 2:
        return -np.inf
    below = [x for x in below if x < min(own)]
    return float(np.nextafter(max(below), np.inf)) if below else float(min(own) - 1)


@dataclass
class Familiarity:
    """Profiles by language, cutoffs (languages x ``LENGTHS``), and the seldom languages."""

    languages: list[str]
    profiles: list[Profile]
    cutoffs: np.ndarray
    seldom: tuple[str, ...] = ()

    def known(self, data: np.ndarray, offsets: np.ndarray, names: list[str | None]) -> np.ndarray:
        """Whether each text reads as the language named for it; not if the language has no profile."""
        n = len(offsets) - 1
        place = {name: k for k, name in enumerate(self.languages)}
        lang = np.array([place.get(x, -1) for x in names], np.int64)
        total, letters = np.zeros(n), np.zeros(n)
        firsts = offsets[:-1][np.diff(offsets) > 0]
        for at in range(0, len(data), CHUNK):
            end = min(at + CHUNK, len(data))
            back = max(0, at - 2)
            first = firsts[np.searchsorted(firsts, back) : np.searchsorted(firsts, end)] - back
            slot, pair, before = (x[at - back :] for x in contexts(data[back:end], first))
            owner = np.searchsorted(offsets, np.arange(at, end), "right") - 1
            counted = (SYMBOL[data[at:end]] > 0) & (lang[owner] >= 0)
            for k, found in enumerate(self.profiles):
                some = np.flatnonzero(counted & (lang[owner] == k))
                if len(some):
                    total += np.bincount(owner[some], found.logs(slot[some], pair[some], before[some]), n)
                    letters += np.bincount(owner[some], minlength=n)
        size = np.maximum(np.searchsorted(LENGTHS, letters, "right") - 1, 0)
        bound = self.cutoffs[lang, size] if len(self.cutoffs) else np.full(n, np.inf)
        return (lang >= 0) & (letters > 0) & (total >= bound * letters)


def fit_familiarity(docs: list[list[bytes]], labels: list[str], seed: int = 11) -> Familiarity | None:
    """Profiles and cutoffs from the windows of labelled documents; None if there are none.

    A window is read from its first blank on, since it may start inside a word.
    """
    random = np.random.default_rng(seed)
    texts = [b" ".join(w[w.find(b" ") + 1 :] if SYMBOL[np.frombuffer(w[w.find(b" ") + 1 :], np.uint8)].any() else w for w in d) for d in docs]
    by_lang: dict[str, list[bytes]] = {}
    for t, x in zip(texts, labels):
        by_lang.setdefault(x, []).append(t)
    names = sorted(by_lang)
    if not names:
        return None
    cutoffs = np.empty((len(names), len(LENGTHS)))
    junk = {x: [shuffled(t, random) for t in by_lang[x]] for x in names}
    for k, x in enumerate(names):
        own, mixed, foreign = [], [], []
        strangers = [t for y in by_lang if y != x for t in by_lang[y]]
        if len(by_lang[x]) < LEAST_DOCS:
            cutoffs[k] = _lax_cutoff(by_lang[x], strangers, random)
            continue
        for f in range(FOLDS):
            unseen = profile([t for j, t in enumerate(by_lang[x]) if j % FOLDS != f])
            own += [letter_logs(unseen, t) for t in by_lang[x][f::FOLDS]]
            mixed += [letter_logs(unseen, t) for t in junk[x][f::FOLDS]]
            foreign += [letter_logs(unseen, t) for t in strangers[f::FOLDS]]
        last = -np.inf
        for j, length in enumerate(LENGTHS):
            means = [np.array([v[:length].mean() for v in part if len(v) >= length]) for part in (own, mixed, foreign)]
            # Too few texts of this length: the cutoff of the next shorter one, which is laxer.
            last = cutoffs[k, j] = cutoff(*means) if len(means[0]) >= LEAST_DOCS else last
    most = max(len(d) for d in by_lang.values())
    seldom = tuple(x for x in names if len(by_lang[x]) < SELDOM * most)
    return Familiarity(names, [profile(by_lang[x]) for x in names], cutoffs, seldom)
