"""Problem 7: prompt and response pairs whose response is no proper answer.

Truncation is found by evidence about endings: JSON or a code fence left open; a neighbour that
extends the text in the order of all prose responses (shortened versions); a length shared by suspiciously many texts; a final
token that is an unknown proper prefix of known words; a last sentence that is the beginning of one
in the request or has the frame of no whole sentence in the corpus. Copy, refusal and language rules
follow. One type per call, the first that holds of: empty, copy, refusal, truncated, wrong_language.

Null, blank and mark-only responses, and JSON without content, are ``empty``. A null request is read
as an empty text. The same key stored twice gives one row; where its rows differ, each is judged and
the first type in the order above stands. Null keys are left out. Texts are read whole.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tidemark.functions.arrow import map_batches, spread
from tidemark.llm import endings
from tidemark.session import cut_lineage

TYPES = ("empty", "copy", "refusal", "truncated", "wrong_language")

#: Frequent function words by language.
STOPWORDS = {
    "en": "the and of to is in that it was for on are with as his they at be this have from or had by not but what all were when we there can an your which their said if do will each about how up out them then she many some so these would other into has more her two like him see time could no make than first been its who now people my made over did down only way find use may long little very after words called just where most know i you get me think would be one",
    "de": "der die das und ist nicht ich ein eine zu den mit auf für im dem von es sich des auch an als wie bei aber nur noch so nach war wird sind oder um haben hat einen einer mir mich dass wenn sie er wir ihr zum zur über wieder doch mein sei erst also ohne nie sehr alles andere dann kam würde etwa bliebe",
    "fr": "le la les de des et est un une que qui dans pour pas sur avec ce il elle je nous vous au aux par plus ne se sont mais ou où comme mon ma son sa cette fait tout très bien à en du si ça moi toujours encore après compte rien sans chez seulement presque cela dirais donc environ",
    "es": "el la los las de y es un una que en por para no con se lo su al del como más pero sus le ya o este sí porque esta entre cuando muy sin sobre también me hasta hay donde quien todo nos mi siempre creo verdad después fin así solo sería seguiría están muy más menos",
    "it": "il lo la gli le di e è un una che non per con si del della sono ma come più anche questo mi ha al dei nel alla molto io tutto essere direi circa",
    "pt": "o a os as de e é um uma que não por para com se do da em no na mais mas como eu foi ao muito também já sua isso está ele diria cerca",
    "nl": "de het een en van is dat in te niet op zijn voor met die aan er om ook als maar bij dan nog wel mijn zou ongeveer ik je",
}
_WORDS = {k: frozenset(v.split()) for k, v in STOPWORDS.items()}
#: Keys and labels in English that an answer may add of its own.
OWN_KEYS = set("rating ratings score scores value answer result results response note notes comment comments reason explanation error message quote quotes direction text status confidence brief evidence".split())
PREFACES = re.compile(r"^\W*(?:you asked|question|q|prompt|request|the request was|user|input|task)\W+", re.I)

REFUSAL = re.compile(
    r"(?i)(?:\b(?:i|we)(?:'m| am|’m)? (?:(?:really|truly|afraid|sorry|,|but|that|i) ){0,4}(?:can(?:no|')?t|can’t|cannot|could ?n['’]?t|won['’]?t|will not|would not|wouldn['’]t|am unable|am not able|do not think i should|don['’]t think i should|do not feel comfortable|don['’]t feel comfortable|"
    r"must (?:decline|refuse)|have to (?:decline|pass|refuse)|decline|refuse|need to decline|prefer not|would rather not|['’]d rather not|stay away from)\b|\bi['’]d rather not\b|\bi['’]m (?:unable|not able|not comfortable|not going)\b|"
    r"\b(?:it |this |that )?(?:is|isn['’]t|is not|would not be|wouldn['’]t be) (?:my place|appropriate|something i (?:stay away|can|do|will))\b|\bsomething i stay away from\b|\bcrosses a line\b|\bagainst my (?:guidelines|policy|principles|rules|values)|"
    r"\bnot (?:able|willing|comfortable|allowed|permitted) (?:to|with)\b|\bno (?:ratings?|scores?) (?:is|are) given\b|\bcannot (?:go along|produce|judge|rate|do|comply|help|assist|answer|provide|fulfil)|\bunable to (?:go along|produce|judge|rate|do|comply|help|assist|answer|provide)|"
    r"\bwill not take part\b|\b(?:declined?|refus(?:e|ed|al))\b|\bnot enough grounds\b|\bcould cause harm\b|\bas an (?:assistant|ai)\b.{0,30}\b(?:not|unable|cannot))"
)


def words(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


def language(tokens: list[str]) -> str | None:
    """The language of most function words, where there are at least two and a clear lead."""
    best = sorted(((sum(t in s for t in tokens), k) for k, s in _WORDS.items()), reverse=True)
    return best[0][1] if best[0][0] >= 2 and best[0][0] > 1.2 * best[1][0] else None


def languages(text: str) -> set[str]:
    """Languages of a text's sentences; English is taken for granted in a request."""
    return {language(words(s)) for s in endings.sentences(text)} - {None} | {"en"}


def open_json(text: str) -> bool:
    """Whether brackets or a string stay open from the first bracket to the end."""
    start = min((i for i in (text.find("{"), text.find("[")) if i >= 0), default=-1)
    if start < 0:
        return False
    depth, inside, escaped = 0, False, False
    for ch in text[start:]:
        if inside:
            if escaped:
                escaped = False
            elif ch == "\\":
                escaped = True
            elif ch == '"':
                inside = False
        elif ch == '"':
            inside = True
        elif ch in "{[":
            depth += 1
        elif ch in "}]" and depth:
            depth -= 1
    return depth > 0 or inside


def parsed(text: str):
    """(value, text around it) of the JSON in a response; value is Ellipsis where there is none."""
    body = re.sub(r"^\s*```\w*\s*|\s*```\s*$", "", text.strip())
    for candidate in (body, *(m[0] for m in [re.search(r"\{.*\}", body, re.S), re.search(r"\[.*\]", body, re.S)] if m)):
        try:
            return json.loads(candidate), body.replace(candidate, " ", 1)
        except ValueError:
            continue
    return ..., body


def parts(request: str) -> list[list[str]]:
    """Words of the request's inner parts (excerpt, brief), for every cut of its paragraphs."""
    p = request.split("\n\n")
    out = []
    for i in (0, 1):
        for j in range(max(i + 1, len(p) - 3), len(p)):
            out.append(words(re.sub(r"^\s*(?:excerpt|brief|lines|text):\s*", "", "\n\n".join(p[i:j]), flags=re.I)))
    return [w for w in out if len(w) >= 5]


def is_copy(request: str, response: str) -> bool:
    answer = PREFACES.sub("", response)
    if len(request) > 200:  # either way of copying below puts the fourth to sixth word into the request
        begin, low = [m[0] for m in islice(re.finditer(r"[^\W_]+", answer.lower()), 6)], request.lower()
        if len(begin) < 5 or any(w not in low for w in begin[3:]):
            return False
    mine, theirs = words(answer), words(request)
    if len(mine) < 5 or not theirs:
        return False
    head = theirs[:6]
    for k in range(min(4, len(mine))):
        if mine[k : k + len(head)] == head:
            tail = mine[k:]
            same = sum(a == b for a, b in zip(tail, theirs))
            return same >= 0.95 * len(theirs) or (same == len(tail) and len(tail) >= 0.6 * len(theirs))
    joined, whole = " ".join(mine), " ".join(theirs)
    if joined not in whole:
        return False
    return any(mine == part for part in parts(request)) or len(mine) >= 0.95 * len(theirs)


def refuses(request: str, response: str, value, around: str) -> bool:
    if isinstance(value, dict):
        said = [v for k, v in value.items() if isinstance(v, str) and k.lower() in OWN_KEYS and k.lower() not in ("quote", "text", "direction")]
        answered = any(isinstance(v, (int, float)) and not isinstance(v, bool) or (isinstance(v, list) and v) for v in value.values())
        return not answered and any(REFUSAL.search(s) for s in said) or (not answered and bool(REFUSAL.search(around)))
    if isinstance(value, (list, int, float)):
        return False
    text = value if isinstance(value, str) else response
    if not REFUSAL.search(text):
        return False
    said = [s.strip() for s in endings.sentences(text)]
    theirs = {s.strip() for s in endings.sentences(request)}
    declining = sum(s not in theirs and bool(REFUSAL.search(s)) for s in said)
    answering = sum(s in theirs for s in said)
    return declining > answering


def wrong_language(request: str, response: str, value, around: str) -> bool:
    if isinstance(value, dict):
        keys = [k for k in value if isinstance(k, str) and k.strip()]
        low = request.lower()
        foreign = [k for k in keys if k.lower() not in low and k.lower() not in OWN_KEYS]
        if keys and len(foreign) > 0.5 * len(keys):
            return True
        prose = words(around)
    else:
        prose = words(value if isinstance(value, str) else "" if value is not ... else response)
    if len(prose) < 4:
        return False
    lang = language(prose)
    return lang is not None and lang != "en" and lang not in languages(request)


def judge(request: str | None, response: str | None) -> tuple[str | None, str | None]:
    """(type, None), or (None, ending) where only the ending of a prose answer is in doubt.

    ``ending``: ``cut`` where the request shows that the last sentence is a beginning, ``open``
    where it has no final mark, ``shut`` where nothing is wrong with it; None beside a sound object.
    """
    request = request or ""
    if response is None or not response.strip():
        return "empty", None
    text = response.strip()
    bare = re.sub(r"^```\w*|```$", "", text).strip()
    if not words(bare) or bare.strip("\"'").lower() in ("null", "none", "n/a", "nil", "undefined", ""):
        return "empty", None
    value, around = parsed(text)
    if value is None or value == "" or value == {} or value == [] or (isinstance(value, str) and not words(value)):
        return "empty", None
    if is_copy(request, value if isinstance(value, str) else text):
        return "copy", None
    if refuses(request, text, value, around):
        return "refusal", None
    if value is ... and (open_json(text) or text.count("```") % 2):
        return "truncated", None
    if value is not ... and not isinstance(value, str):
        return ("wrong_language", None) if wrong_language(request, text, value, around) else (None, None)
    prose = value if isinstance(value, str) else text
    foreign = wrong_language(request, text, value, around)
    if endings.CUT_MARK.search(prose) and not prose.rstrip().endswith("..."):
        return "truncated", None
    if endings.END_MARK.search(prose) or not endings.last_token(prose):
        return ("wrong_language", None) if foreign else (None, "shut")
    if foreign:
        return "wrong_language", "open"
    theirs, mine = endings.sentences(request), endings.sentences(prose)
    last = mine[-1]
    if any(s.rstrip(".!?") == last for s in theirs):
        return None, "shut"
    if any(s.startswith(last) for s in theirs):
        return None, "cut"
    brief = endings.sentences("\n\n".join(request.split("\n\n")[1:-1]))
    if len(mine) < len(brief) and set(mine) & set(brief):
        return None, "cut"
    return None, "open"


STAGED = "key string, kind string, ending string, token string, frame_a string, frame_b string, text string, length int"


def judged(key: str, request: str | None, response: str | None) -> tuple | None:
    """A row of ``STAGED`` for a call with a defect or a prose response, else None."""
    kind, ending = judge(request, response)
    if kind is None and ending is None:
        return None
    last = endings.sentences(response)[-1:] if ending in ("cut", "open") else []
    a, b = (endings.frames(last[0]) if last else None) or (None, None)
    return key, kind, ending, endings.last_token(response) if last else None, a, b, response.strip() if ending else None, len(response or "")


class Evidence:
    """What one pass over the calls gives, written once: judged rows, known words, frames of whole sentences.

    A sound JSON answer is no row: it cannot be the longer version of a prose text. Words and frames are of
    all requests and responses, those without a key too.
    """

    def __init__(self, calls: DataFrame):
        schema = "part string, " + STAGED + ", word string, n bigint"
        names = [x.split()[0] for x in schema.split(", ")]
        none = (None,) * (len(names) - 3)

        def run(batch: pa.RecordBatch):
            counts: Counter = Counter()
            frames: set[str] = set()
            for key, request, response in zip(*(c.to_pylist() for c in batch.columns)):
                for text in (request, response):
                    if text:
                        counts.update(endings.known_words(text))
                        frames |= endings.whole_frames(text)
                row = judged(key, request, response) if key is not None else None
                if row:
                    yield ("row", *row, None, None)
            for word, n in counts.items():
                yield ("word", *none, word, n)
            for frame in frames:
                yield ("frame", *none, frame, None)

        rows = cut_lineage(map_batches(spread(calls.select("key", "request", "response")), run, schema, names))
        self.rows = rows.filter("part = 'row'").select(*names[1:-2])
        self.words = rows.filter("part = 'word'").groupBy("word").agg(F.sum("n").alias("n"))
        self.frames = rows.filter("part = 'frame'").select(F.col("word").alias("frame")).distinct()
        self.lengths = calls.select(F.length("response").alias("length"))


def shortened(texts: DataFrame) -> DataFrame:
    """The texts in doubt that another text extends: ``text``. ``texts``: text, doubt.

    Different texts are sorted, each once however many rows share it. All texts that begin with a text
    follow it at once, so its successor decides. The successor of a partition's last text is the first
    text of the next partition that has any; partitions hand these two on, a row for each partition.
    """
    schema = "text string, part int, head string, doubt boolean"

    def run(batches):
        from pyspark import TaskContext

        part, head, held, asked = TaskContext.get().partitionId(), None, None, False
        for batch in batches:
            out = []
            for text, doubt in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if held is None:
                    head = text
                elif asked and text.startswith(held):
                    out.append(held)
                held, asked = text, doubt
            n = len(out)
            if n:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.string()), pa.nulls(n, pa.bool_())], names=["text", "part", "head", "doubt"])
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([held]), pa.array([part], pa.int32()), pa.array([head]), pa.array([asked])], names=["text", "part", "head", "doubt"])

    once = texts.filter("text is not null").groupBy("text").agg(F.max("doubt").alias("doubt"))
    rows = cut_lineage(once.repartitionByRange("text").sortWithinPartitions("text").mapInArrow(run, schema))
    ends = rows.filter("part is not null").withColumn("next", F.lead("head").over(Window.orderBy("part")))
    return rows.filter("part is null").select("text").unionByName(ends.filter(F.col("doubt") & F.col("next").startswith(F.col("text"))).select("text"))


def open_endings(found: Evidence) -> DataFrame:
    """Keys of the open endings that evidence shows to be cuts.

    An open ending is a cut where a neighbour among all prose responses extends it, where its final
    token is an unknown proper prefix, or where its last sentence has the frame of no whole sentence of
    the corpus. A length that is a limit of the field makes a frame count only if both of its keys are
    known.
    """
    rows = found.rows
    open_rows = (F.col("ending") == "open") & F.col("kind").isNull()
    doubt = rows.filter(open_rows)
    unknown = endings.unknown_prefixes(doubt.filter("token is not null").select("key", "token"), found.words).select("key")
    longer = shortened(rows.select("text", F.coalesce(open_rows, F.lit(False)).alias("doubt")))
    neighbour = doubt.join(longer, "text", "left_semi").select("key")
    keys = doubt.select("key", "length", F.explode(F.array_distinct(F.array("frame_a", "frame_b"))).alias("frame"))
    framed = keys.join(found.frames, "frame", "left_semi").groupBy("key", "length").agg(F.count("*").alias("n"))
    spikes = endings.length_spikes(found.lengths, "length").withColumn("limit", F.lit(True))
    trusted = framed.join(spikes, "length", "left").filter("limit is null or n > 1 ").select("key")
    unframed = doubt.select("key").join(trusted, "key", "left_anti")
    return unknown.unionByName(neighbour).unionByName(unframed).distinct()


def cut_keys(found: Evidence) -> DataFrame:
    """Keys of all calls whose response breaks off."""
    sure = found.rows.filter("kind = 'truncated' or (kind is null and ending = 'cut')").select("key")
    return sure.unionByName(open_endings(found)).distinct()


def found(calls: DataFrame) -> DataFrame:
    """Defective calls: ``call_key``, ``defect_type``; one row a key."""
    seen = Evidence(calls)
    plain = seen.rows.filter("kind is not null").select("key", "kind")
    cut = cut_keys(seen).select("key", F.lit("truncated").alias("kind"))
    order = F.array_position(F.array(*[F.lit(t) for t in TYPES]), F.col("kind"))
    best = plain.unionByName(cut).groupBy("key").agg(F.min_by("kind", order).alias("defect_type"))
    return best.select(F.col("key").alias("call_key"), "defect_type")
