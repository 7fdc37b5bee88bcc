"""Problem 10: the subject areas of each document, and the make-up of the corpus by area.

The areas are those of the ``subjects`` table. Weighted terms are curated from a fixed seed list, the
areas' descriptions and labelled documents, matched by a multi-pattern automaton, weighted by rarity,
and counted by sentence, the areas that a sentence speaks for about equally sharing it. A document's
count for an area is normalised by its length in sentences, less a correction for single mentions; an
area is assigned where this exceeds the area's threshold. Correction and thresholds are calibrated on
labelled documents that were held out from learning the terms (cross-fitted halves of the sample).

The driver learns and calibrates on at most ``most`` labelled documents (default 4,000, those of least
hash of their id) of at most ``longest`` characters (default 20,000): the documented bounds of the
training sample. Labels are noisy, so terms are re-estimated a few times: sentences are given to the
area their terms speak for, labels entering as a prior only. All documents are then classified, whole,
with the automaton broadcast (its size follows the bounded sample).

Null and blank texts have no row. Labels with a null subject or one that is in no subject row, or for
unknown documents, are ignored; case and stray blanks do not matter. Without labels the seed terms and
default thresholds are used as they are. Documents with a null id are left out; repeated ids give a row
per id and area.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tidemark.functions.arrow import map_batches, spread

#: Seed terms of each area.
SEEDS = {
    "science": "telescope, isotope, enzyme, petri dish, preprint, peer review, centrifuge, lab notebook, particle detector, error bar, hypothesis, reagent, spectrum, field sample",
    "law": "statute, affidavit, plaintiff, injunction, deposition, precedent, notary, bylaw, jury summons, witness statement, contract clause, power of attorney, parking tribunal, ruling",
    "sport": "goalkeeper, midfield, referee, offside trap, penalty shootout, scrum, relay team, backhand, sprint finish, league table, training camp, home fixture, transfer window, playoff",
    "software": "compiler, unit test, null pointer, memory leak, pull request, stack trace, feature flag, linter, parser, race condition, api gateway, message queue, build server, query planner",
    "health": "migraine, inhaler, vaccine, prescription, blood pressure, dentist, rash, allergy test, sprained ankle, blood test, physio session, knee brace, waiting room, dosage",
    "money": "mortgage rate, savings account, dividend, overdraft, tax return, credit card, index fund, student loan, pension, net worth, emergency fund, bond ladder, rebate, payslip",
    "food": "risotto, sourdough starter, marinade, roux, custard, lentil stew, olive brine, chilli oil, cast iron pan, flatbread, pastry crust, soup pot, rolling pin, spice rack",
    "travel": "boarding pass, layover, hostel, suitcase, itinerary, visa office, night train, border crossing, customs line, mountain pass, rental car, backpack, ferry, guidebook",
    "gaming": "boss fight, loot table, hitbox, respawn timer, skill tree, leaderboard, side quest, cutscene, speedrun, dungeon, matchmaking, mod loader, save file, inventory slot",
    "music": "chord progression, bass line, guitar pedal, mixing desk, drum loop, setlist, string quartet, reverb, melody, snare, chorus, tempo, encore, synth patch",
    "homecraft": "tomato seedling, leaky tap, sewing machine, wood stain, plasterboard, grout, compost heap, shelf bracket, drill bit, fence post, knitting pattern, wheelbarrow, primer coat, raised bed",
    "history": "manuscript, siege, treaty, dynasty, chronicle, parish register, coin hoard, burial mound, fortress, census roll, plague year, excavation, oral account, trade route",
}
#: Words that name no area in any language of the corpus.
STOP = set(
    "the and that this with for was were are not but you your have has had from they them then than what who how why when where which there here all any can could "
    "would should will just about into over after before until because like some more most very much our its his her she him one two out get got did does don't "
    "der die das und ist nicht ich ein eine den mit auf für von des dem les des une est que qui dans pour pas sur avec los las una por para con del como más".split()
)
TOKEN = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")
SENTENCE = re.compile(r"[^.!?\n]+[.!?]*")


def sentence_list(text: str) -> list[str]:
    return [s for s in SENTENCE.findall(text) if len(TOKEN.findall(s)) >= 2]


def terms_of(sentence: str) -> set[str]:
    """Words and word pairs that may be terms."""
    w = [x.lower() for x in TOKEN.findall(sentence)]
    out = {x for x in w if len(x) > 2 and x not in STOP}
    out |= {f"{a} {b}" for a, b in zip(w, w[1:]) if len(a) > 1 and len(b) > 2 and not (a in STOP and b in STOP)}
    out |= {f"{a} {b} {c}" for a, b, c in zip(w, w[1:], w[2:]) if len(c) > 2 and b in ("of", "de", "la")}
    return out


def learn(labelled: list[tuple[str, set[str]]], descriptions: dict[str, str] | None = None, rounds: int = 3, least: int = 3, purity: float = 0.45) -> dict[str, dict[str, float]]:
    """Weights by term and area, from (text, areas) pairs.

    ``descriptions``: what each area is about; None for the areas of the seed list. The words of the
    description are seeds where the list has none.

    A term's weight for an area is its share of the term's sentences there beyond chance, times the
    log of how rare the term is; ambiguous terms keep smaller weights for several areas.
    """
    weights: dict[str, dict[str, float]] = defaultdict(dict)
    for area in sorted(descriptions) if descriptions is not None else SEEDS:
        listed = SEEDS[area].split(", ") if area in SEEDS else sorted(terms_of(f"{area} {descriptions[area] or ''}"))
        for t in listed:
            weights[t][area] = 3.0
    rows = [([terms_of(s) for s in sentence_list(text)], areas) for text, areas in labelled]
    rows = [(s, a) for s, a in rows if s and a]
    if not rows:
        return dict(weights)
    seen: Counter = Counter(t for sentences, _ in rows for s in sentences for t in s)
    n_sentences = sum(len(s) for s, _ in rows)
    seeds = {t: dict(w) for t, w in weights.items()}
    for step in range(rounds):
        counts: dict[str, Counter] = defaultdict(Counter)
        for sentences, areas in rows:
            prior = 1.0 if step == 0 else 0.5
            around: Counter = Counter()
            scored = []
            for s in sentences:
                score: Counter = Counter()
                for t in s:
                    for a, w in weights.get(t, {}).items():
                        score[a] += w
                scored.append(score)
                if score:
                    a, w = score.most_common(1)[0]
                    if w > 1:
                        around[a] += 1
            for s, score in zip(sentences, scored):
                total: Counter = Counter(score)
                for a in areas:
                    total[a] += prior
                for a, n in around.items():
                    total[a] += 0.5 * n / len(sentences)
                best = total.most_common(2)
                a, w = best[0]
                second = best[1][1] if len(best) > 1 else 0.0
                if not score and len(areas) > 1:
                    continue
                strength = 1.0 if score and w - second > 0.5 else 0.35
                for t in s:
                    counts[t][a] += strength
        fresh: dict[str, dict[str, float]] = defaultdict(dict)
        mass: Counter = Counter()
        for c in counts.values():
            mass.update(c)
        whole = sum(mass.values()) or 1
        for t, c in counts.items():
            n = sum(c.values())
            if seen[t] < least:
                continue
            for a, k in c.items():
                chance = mass[a] / whole
                share = (k + chance) / (n + 1)
                if share >= purity / 2 and share >= 2.5 * chance:
                    rarity = min(1.0, math.log(n_sentences / seen[t]) / 6)
                    fresh[t][a] = round(3 * max(0.0, (share - chance) / (1 - chance)) * rarity, 3)
        for t, w in seeds.items():
            if t not in fresh or seen[t] < 3 * least:
                for a, x in w.items():
                    fresh[t][a] = max(fresh[t].get(a, 0.0), x)
        weights = fresh
    return {t: w for t, w in weights.items() if max(w.values(), default=0) >= 0.6}


class Matcher:
    """The automaton over all terms; built once per task."""

    def __init__(self, weights: dict[str, dict[str, float]]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for t, w in weights.items():
            self.automaton.add_word(" " + t + " ", tuple(w.items()))
        if len(self.automaton):
            self.automaton.make_automaton()

    def areas(self, sentence: str) -> dict[str, float]:
        """Summed weights of the terms in the sentence, by area."""
        out: dict[str, float] = {}
        if not len(self.automaton):
            return out
        text = " " + " ".join(x.lower() for x in TOKEN.findall(sentence)) + " "
        for _, w in self.automaton.iter(text):
            for a, x in w:
                out[a] = out.get(a, 0.0) + x
        return out

    def profile(self, text: str, floor: float = 1.0, equal: float = 0.9) -> tuple[dict[str, float], int]:
        """Sentences given to each area, and the number of sentences. Areas within ``equal`` of the best share one."""
        given: dict[str, float] = {}
        sentences = sentence_list(text)
        for s in sentences:
            score = self.areas(s)
            best = max(score.values(), default=0.0)
            if best >= floor:
                ahead = [a for a, x in score.items() if x >= equal * best]
                for a in ahead:
                    given[a] = given.get(a, 0.0) + 1 / len(ahead)
        return given, len(sentences)


class Limits:
    """Calibrated decision: an area is assigned where ``(count - less) / sentences`` reaches its threshold."""

    def __init__(self, less: float = 0.3, by_area: dict[str, float] | None = None, default: float = 0.16):
        self.less, self.by_area, self.default = less, by_area or {}, default

    def score(self, count: float, n: int) -> float:
        return (count - (self.less if n > 2 else 0.0)) / n

    def areas(self, given: dict[str, float], n: int) -> list[tuple[str, float]]:
        """(area, share of sentences) of the assigned areas."""
        return sorted((a, k / n) for a, k in given.items() if self.score(k, n) >= self.by_area.get(a, self.default))


def calibrate(profiles: list[tuple[dict[str, float], int, set[str]]], least: int = 20, prior: float = 150.0, slack: float = 0.0005) -> Limits:
    """Limits of best F1 on (counts, sentences, labelled areas) of held-out documents.

    One correction and one threshold are fitted over all areas, then a threshold for each area with at
    least ``least`` labels, the counts of all areas weighing in as ``prior`` labels. Too few documents:
    the defaults.
    """
    profiles = [p for p in profiles if p[1] and p[2]]
    if len(profiles) < least:
        return Limits()
    grid = np.round(np.arange(0.08, 0.301, 0.01), 2)
    names = sorted({a for g, _, labels in profiles for a in set(g) | labels})
    truth = np.array([[a in labels for a in names] for _, _, labels in profiles])
    true = truth.sum(0)
    f1 = lambda both, got, true: 2 * both / np.maximum(got + true, 1)
    middle = lambda x: int(np.median(np.flatnonzero(x >= x.max() - slack)))
    best = (-1.0, 0.0, 0, None)
    for less in (0.0, 0.15, 0.3, 0.45, 0.6, 0.75):
        rule = Limits(less)
        hit = np.array([[rule.score(g.get(a, 0.0), n) for a in names] for g, n, _ in profiles])[None] >= grid[:, None, None]
        both, got = (hit & truth).sum(1), hit.sum(1)
        micro = f1(both.sum(1), got.sum(1), true.sum())
        if micro.max() > best[0]:
            best = (float(micro.max()), less, middle(micro), (both, got))
    _, less, at, (both, got) = best
    own, w = {}, prior / max(1, true.sum())
    for j, a in enumerate(names):
        if true[j] >= least:
            own[a] = float(grid[middle(f1(both[:, j] + w * both.sum(1), got[:, j] + w * got.sum(1), true[j] + prior))])
    return Limits(less, own, float(grid[at]))


def assign(matcher: Matcher, text: str | None, limits: Limits) -> list[tuple[str, float]]:
    """(area, share of sentences) for every area above its limit."""
    if not text or not text.strip():
        return []
    given, n = matcher.profile(text)
    return limits.areas(given, n) if n else []


BLANK = " \t\n\r"


def training_sample(documents: DataFrame, labels: DataFrame, areas: list[str] | None, most: int, longest: int) -> list[tuple[str, set[str]]]:
    """At most ``most`` labelled documents, chosen by hash of their id, with their cleaned labels."""
    name = F.lower(F.trim("subject", F.lit(BLANK)))
    good = labels.filter("doc_id is not null").select("doc_id", name.alias("subject")).filter("subject != ''")
    good = (good.filter(F.col("subject").isin(*areas)) if areas is not None else good).groupBy("doc_id").agg(F.collect_set("subject").alias("areas"))
    picked = good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = documents.select("doc_id", "text").filter(F.length("text") <= longest).join(picked, "doc_id").orderBy("doc_id").select("text", "areas").toArrow()
    return [(t, set(a)) for t, a in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist())]


def fit(documents: DataFrame, labels: DataFrame, subjects: DataFrame | None, most: int = 4000, longest: int = 20_000) -> tuple[dict, Limits]:
    """Terms and limits: each half of the sample is counted with terms learned from the other half, which
    calibrates the limits; the terms that are used come from the whole sample.

    ``subjects``: subject and description, a short fixed list; None takes the areas of the seed list
    and of the labels.
    """
    listed = None
    if subjects is not None:
        rows = subjects.filter("subject is not null").select(F.lower(F.trim("subject", F.lit(BLANK))).alias("subject"), F.substring("description", 1, 1000).alias("description")).distinct().limit(1001).collect()
        if len(rows) > 1000:
            raise ValueError("at most 1,000 areas")
        listed = {r["subject"]: r["description"] for r in rows}
    sample = training_sample(documents, labels, sorted(listed) if listed is not None else None, most, longest)
    halves, counted = (sample[0::2], sample[1::2]), []
    for mine, other in (halves, halves[::-1]):
        matcher = Matcher(learn(other, listed))
        counted += [(*matcher.profile(t), areas) for t, areas in mine]
    return learn(sample, listed), calibrate(counted)


def shares(documents: DataFrame, labels: DataFrame, subjects: DataFrame | None = None, **how) -> DataFrame:
    """``doc_id``, ``subject``, ``share`` of sentences, for every assigned area."""
    shared = documents.sparkSession.sparkContext.broadcast(fit(documents, labels, subjects, **how))

    def run(batch: pa.RecordBatch, state):
        matcher, limits = state
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for area, share in assign(matcher, text, limits):
                yield key, area, share

    docs = spread(documents.filter("doc_id is not null").select("doc_id", "text"))
    return map_batches(docs, run, "doc_id bigint, subject string, share double", ["doc_id", "subject", "share"], setup=lambda: (Matcher(shared.value[0]), shared.value[1]))


def found(documents: DataFrame, labels: DataFrame, subjects: DataFrame | None = None) -> DataFrame:
    """``doc_id``, ``subject``, distinct."""
    return shares(documents, labels, subjects).select("doc_id", "subject").distinct()


def makeup(documents: DataFrame, labels: DataFrame, subjects: DataFrame | None = None) -> DataFrame:
    """Per area: documents that have it and its part of all assigned sentence shares."""
    rows = shares(documents, labels, subjects)
    by = rows.groupBy("subject").agg(F.countDistinct("doc_id").alias("n_docs"), F.sum("share").alias("weight"))
    total = F.sum("weight").over(Window.partitionBy())
    return by.select("subject", "n_docs", F.round(F.col("weight") / total, 6).alias("share"))
