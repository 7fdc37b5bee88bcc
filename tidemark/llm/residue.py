"""Problem 4: template residue, filler, error pages and script notices in place of a member's words.

Every text with a cue is scored, and the points of all kinds of evidence are added up: placeholder
detectors (unfilled slots, filler, server and script notices: 2, or 1 for phrases that a page shares
with people) over the prose that is left once code, formulas, wiki templates and quoted strings are
blanked; 1 where every sentence of the text is such a phrase; 1 where the phrases, numbers aside, stand
in three items or more, and half a point more where these come from several hosts (subreddits); 1
where the text says little and its title line or address slug is not taken up by its body. Two points
flag the item. A sentence in a member's own voice counts as no evidence.

The slug of an address is empty in most histories (``_``); it then says nothing. Null, blank and
tombstone bodies (``[deleted]``, ``[removed]``) carry no residue. Texts are read whole. Of repeated
rows of an item one flagged row flags the item. Extra columns are ignored.
"""

from __future__ import annotations

import re

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from tidemark.functions.arrow import map_batches, spread
from tidemark.session import cut_lineage

#: HTTP reason phrases.
REASONS = (
    "Bad Request|Unauthori[sz]ed|Payment Required|Forbidden|Not Found|Method Not Allowed|Not Acceptable|Request Time-?out|Conflict|Gone|"
    "Payload Too Large|Too Many Requests|Internal Server Error|Not Implemented|Bad Gateway|Service (?:Temporarily )?Unavailable|"
    "Gateway Time-?out|Connection Timed Out|Web Server Is Down|Access Denied|Page Not Found"
)
#: The words of the usual Latin filler.
LATIN = set(
    "lorem ipsum dolor sit amet consectetur adipiscing adipisicing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam "
    "quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit "
    "esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum".split()
)
_LATIN_SURE = set("lorem ipsum consectetur adipiscing adipisicing eiusmod incididunt veniam nostrud ullamco laboris aliquip commodo consequat aute irure reprehenderit voluptate cillum fugiat pariatur excepteur sint occaecat cupidatat proident deserunt mollit laborum amet".split())

SLOT = re.compile(
    r"\{\{\{?\s*(?!Infobox|cite|Cite|infobox|[A-Z][a-z]+ [a-z]|[^{}]*\|)[A-Za-z_$][\w.\-\[\] ]*\}\}\}?"
    r"|[$#]\{\{?\s*[A-Za-z_][\w.]*\s*\}\}?"
    r"|(?<![\\\w}_^])\{(?:\d|[a-z]+(?:_[a-z]+)+|(?:user|first|last|full|account|member|recipient|customer|company|city|date|title|name|subject|author|username|firstname|lastname|email|link|url|product|topic)[a-z_]*)\}"
    r"|%\([a-z_]+\)[sd]|%[A-Z][A-Z_]{2,}%|%%[A-Za-z_]+%%"
    r"|<%=?\s*[\w.]+\s*%>|<<\s*[\w.]+\s*>>|@@\w+@@|\*\|[A-Z_]+\|\*|(?<![\w$])\$[A-Z][A-Z_]{2,}\$|\{%\s*\w[^%\n]*%\}|<[A-Z]{2,}(?:_[A-Z]+)+>|(?<!\w)(?:__|XX+_?)[A-Z][A-Z_]+(?:__|_?XX+)(?!\w)"
    r"|\[(?:(?:your|first|last|full|insert|enter|company|user|member|recipient|customer|product|organi[sz]ation|date|city|title|subject)(?:[ _][a-z]+)*|[A-Z]{4,}(?:[ _][A-Z]+)*|COMPANY|NAME)\](?!\()",
)
SLOT_I = re.compile(r"(?i)\[(?:your|insert|enter|first|last|full|company|recipient|customer) ?[a-z_ ]*\](?!\()")
VOID = re.compile(r"\b(?:Hello|Hi|Dear|Welcome to|Welcome,|Regards,|Thanks,|Posted by|Reminder for|See|Greetings|submission|in|on|for) (?:undefined|null|None|NaN|\[object Object\])(?=[\s,.!:;]|$)|(?m:^(?:undefined|null|NaN|\[object Object\]) (?:replied|commented|posted))")
FILLER = re.compile(
    r"(?i)\b(?:this is (?:some |a )?(?:placeholder|sample|dummy|filler) text|placeholder text\b.{0,40}\breplace|replace (?:it|this) with your own|"
    r"(?:body|your|page|headline|main)? ?(?:copy|text|content|title|caption) goes here|(?:sample text[ .]*){2,}|(?:asdf\w*[ .]*){2,}|(?:test[ .]+){2,}(?:test|123)|"
    r"(?:blah[ ,.]*){3,}|content coming soon|editor to supply|todo: ?(?:write|add|fill|insert)|tbd: ?\w+|to be (?:written|filled in) by the editor|"
    r"hier steht später|hier (?:kommt|folgt) (?:der|ihr) text|platzhaltertext|blindtext|texte (?:à venir|de remplissage)|votre texte ici|texto de (?:relleno|ejemplo|prueba)|su texto aquí|aquí va (?:el|su) texto|"
    r"click (?:here )?to (?:edit|add) (?:this |your )?text|double[- ]click to edit|insert (?:your )?(?:text|description|content) here)"
)
STATUS = re.compile(
    rf"(?im)(?:\bHTTP/\d(?:\.\d)? +[45]\d\d\b|\b[45]\d\d[ :\-–]+(?:{REASONS})\b|\b(?:{REASONS})[ :\-–(]+[45]\d\d\b|^\W*(?:status|error|code|http)\W{{0,3}}[45]\d\d\b|"
    rf"\bstatus: ?[45]\d\d\b|<(?:title|h1|h2|h3)>\s*(?:\d{{3}}\s*)?(?:{REASONS})\s*</|\"(?:error|status|code)\": ?\"?[45]\d\d\b|"
    r"\berror \d{3,4}: ?\w|\btraceback\b\W.{0,20}\b\w*error\b|\btraceback \(most recent call last\)|\b\w+(?:Error|Exception) while (?:rendering|processing|loading))"
)
NOTICE = re.compile(
    r"(?i)(?:\binternal server error\b|\bpage not found\b|\bthe (?:requested )?(?:page|thread|resource|url|document|post|comment|file|item)(?: you (?:requested|are looking for))? "
    r"(?:could not be (?:found|located|loaded|displayed)|does not exist|is (?:no longer|not|currently un)\s?available|was not found|has been (?:moved|removed or)|cannot be found|no longer exists)|"
    r"\bis no longer available at this location|\bthe server (?:cannot|could not|was unable to) (?:process|complete|handle)|\bno route matches|\bupstream (?:host|server) (?:closed|did not|failed|timed)|"
    r"\bsending requests too quickly|\brate limit exceeded|\bblocked your (?:region|country|ip|access)|\bthe owner of this (?:site|website)|\bif you are the (?:owner|site owner|administrator)|"
    r"\borigin connection timed out|\bcontact the (?:site )?administrator|\byou do(?:n't| not) have permission to (?:access|view)|\baccess (?:to this (?:page|resource|site) )?(?:is|has been|was) (?:denied|restricted)|"
    r"\bsomething went wrong\W.{0,40}(?:try again|reload)|\bunable to (?:load|display|reach) (?:this|the) (?:page|comments?|thread|content|server)|\brequest id\b|\bray id\b|\btemplateerror\b|"
    r"\bseite (?:wurde )?nicht gefunden|\bseite ist (?:derzeit )?nicht (?:verfügbar|erreichbar)|\bverschoben oder gelöscht|\binterner serverfehler|\bzugriff verweigert|"
    r"\bpage (?:est )?introuvable|\bpage non trouvée|\bn['’]existe (?:pas|plus)\b.{0,30}\b(?:serveur|adresse|page)|\bla page (?:demandée|que vous)|\bcette page n['’]|\berreur interne|\baccès (?:refusé|interdit)|"
    r"\bpágina no (?:encontrada|está|se)|\besta página no|\bno se (?:ha podido|pudo) (?:encontrar|cargar)|\berror interno|\bacceso denegado)"
)
RETRY = re.compile(r"(?i)\b(?:please )?(?:try again (?:later|in \w+ (?:few )?(?:minutes?|seconds?|moments?))|wait \d+ seconds and (?:try again|retry)|refresh (?:the page|and try)|bitte versuchen sie es|veuillez réessayer|réessayez|inténtelo|vuelva a intentarlo)")
SCRIPT = re.compile(
    r"(?i)(?:\b(?:please |you need to |you must |must |to )?(?:enable|turn on|activate|allow|accept|switch on|unblock) (?:\w+ ){0,2}?(?:java ?script|cookies|scripts?|scripting)\b|"
    r"\b(?:needs?|requires?|relies on|depends on|uses|without|won't work without) (?:\w+[\w-]* ){0,6}?(?:java ?script|scripting|scripts?|cookies)\b|"
    r"\b(?:java ?script|scripts?|scripting|cookies) (?:\w+ ){0,3}?(?:disabled|blocked|turned off|switched (?:on|off)|required|not (?:enabled|supported)|enabled)\b|"
    r"\bscripts from this (?:domain|site)|<noscript\b|\bchecking (?:your browser|if the site connection|that you are)|\bverify(?:ing)? (?:that )?you(?:'re| are) (?:a )?(?:human|not a robot)|"
    r"\bprove (?:that )?you(?:'re| are) (?:human|not a robot)|\bcomplete the (?:captcha|security check)|\bcaptcha\b|\bddos protection|\byour browser (?:is|does|will|has)\b|\bbrowser check\b|\bredirected? (?:you )?(?:shortly|automatically)\b|"
    r"\bthis site uses cookies|\bwe use cookies|\bcookie (?:settings|preferences|policy|consent)|\bjava ?script (?:aktivieren|einschalten)|\b(?:aktivieren|erlauben) sie (?:java ?script|cookies)|\bactive[rz] (?:le )?java ?script|\bactivez les cookies|"
    r"\b(?:active|habilite|activar|habilitar) (?:el )?java ?script|\bacepte las cookies|\b(?:benötigt|braucht|erfordert) java ?script|\b(?:nécessite|requiert) java ?script|\b(?:necesita|requiere) java ?script)"
)
#: Phrases of pages that people use too: one point.
WEAK = re.compile(
    r"(?i)(?:\b(?:your|this|the) (?:session|link|token|login|request) (?:has |is |was )?(?:expired|timed out|no longer valid)|\b(?:log|sign) (?:back )?in (?:again )?to (?:continue|proceed|view|see)|"
    r"\bsomething went wrong\b|\b(?:go|return|back) (?:back )?to (?:the |our )?(?:home|start|front) ?page|\b(?:page|content|site|document|thread) (?:cannot|can['’]?t|could not|couldn['’]?t) be (?:displayed|shown|reached|opened|loaded)|\blorem ipsum\b)"
)
#: A member speaking about such things.
TELLING = re.compile(r"(?i)\b(?:i|i['’]m|i['’]ve|i['’]d|my|me|mine)\b|(?<![\"'])(?<!ray )(?<!request )\b(?:id|im|ive) (?=[a-z])|\b(?:we|they|he|she|someone|somebody) (?:got|had|saw|kept|tried|were|was)\b")
#: What people report in the past tense about a phrase that a page shares with them.
PAST = re.compile(r"(?i)\b(?:was|were|had|hadn['’]?t|got|said|kept|turned|noticed)\b")
#: A sentence that reports what some letter or page said.
REPORTED = re.compile(r"(?i)\b(?:literally|(?:started|began|opened|ended) with|it (?:just )?(?:said|read))\b")
CODE = re.compile(r"(?ms)^(```+|~~~+).*?(?:^\1[^\n]*$|\Z)|<pre\b.*?</pre>|<code\b.*?</code>|`[^`\n]+`|\\begin\{(\w+)\}.*?\\end\{\2\}|\$\$.*?\$\$|\\\(.*?\\\)|\\\[.*?\\\]|^(?: {4}|\t)\S[^\n]*$")
BRACES = re.compile(r"\\[a-zA-Z]+\*?(?:\[[^\]\n]*\])?(?:\{[^{}\n]*\})+|[_^]\{[^{}\n]*\}|\{\\\w+ [^{}\n]*\}|\{\{(?:Infobox|infobox|cite|Cite)[^{}]*\}\}|\{\{[^{}\n]*\|[^{}]*\}\}|\{\|.*?\|\}", re.S)
QUOTED = re.compile(r"(?<![\w])(?:'[^'\n]+'|\"[^\"\n]+\"|“[^”\n]+”|‘[^’\n]+’|«[^»\n]+»)(?!\w)")
SENTENCE = re.compile(r"(?<=[.!?…])\s+|\n+")
WORD = re.compile(r"[^\W\d_]+")
SKELETON = re.compile(r"\b(?=\w*\d)[\da-z]+\b|\d+")

PREFILTER = (
    r"(?i:\{\{|\}\}|[$#]\{|\{[a-z_0-9]+\}|%\([a-z_]+\)|%%?[a-z_]+%|<%|<<|@@|\*\||\$[A-Z_]+\$|\{%|__[A-Z]|\bXX|\[(?:your|first|last|full|insert|enter|company|user|member|recipient|customer|product|organi|date|city|title|subject|name|[A-Z]{4})|"
    r"undefined|\bnull\b|\bnone\b|\bnan\b|object object|lorem|ipsum|dolor|veniam|irure|cillum|mollit|nostrud|laborum|proident|aliqu|esse|"
    r"placeholder|sample text|dummy|filler|goes here|asdf|test test|blah|coming soon|todo|tbd|your own|your text|hier steht|hier kommt|hier folgt|platzhalter|blindtext|texte|texto|"
    r"\b[45]\d\d\b|http/|not found|not exist|no longer|unavailable|server|traceback|error|forbidden|denied|blocked|permission|gateway|timed|time-?out|request|route matches|rate limit|went wrong|unable to|owner of|are the owner|"
    r"gefunden|verfügbar|erreichbar|gelöscht|serverfehler|verweigert|introuvable|trouvée|demandée|cette page|erreur|accès|página|error interno|acceso|no se |"
    r"java ?script|scripts?\b|scripting|cookie|noscript|browser|captcha|human|robot|ddos|try again|versuchen|réessayer|réessayez|inténtelo|intentarlo|refresh|redirect|"
    r"not be|cannot be|can.t be|n.existe|page que|to edit|to add|by the editor|to supply|text here|description here|content here|session|expired|log (?:back )?in|sign (?:back )?in|home ?page|start ?page|front ?page|request id|ray id|administrator|no se)|<[A-Z]{2,}_"
)


def _sentences(text: str):
    return [s for s in SENTENCE.split(text) if s.strip()]


def evidence(text: str | None) -> tuple[dict[str, float], list[str], float]:
    """Points by kind (``slot``, ``filler``, ``error``, ``script``), the sentences that gave them, and
    their share of all sentences."""
    if not text or text.strip() in ("", "[deleted]", "[removed]"):
        return {}, [], 0.0
    out: dict[str, float] = {}
    prose = BRACES.sub(" ", CODE.sub(" ", text))
    bare = QUOTED.sub(" ", prose)
    said, total = [], 0

    def note(kind, points, sentence):
        out[kind] = max(out.get(kind, 0.0), points)
        said.append(sentence)

    for s in _sentences(bare):
        if (SLOT.search(s) or SLOT_I.search(s) or VOID.search(s)) and not REPORTED.search(s):
            note("slot", 2.0, s)
        words = [w.lower() for w in WORD.findall(s)]
        latin = sum(w in LATIN for w in words)
        if latin >= 4 and latin >= 0.6 * len(words) and sum(w in _LATIN_SURE for w in words) >= 2:
            note("filler", 2.0, s)
    for m in FILLER.finditer(bare):
        note("filler", 2.0, m[0])
    for s in _sentences(prose):
        total += 1
        if TELLING.search(s):
            continue
        if STATUS.search(s) or NOTICE.search(s):
            note("error", 2.0, s)
        elif (RETRY.search(s) or WEAK.search(s)) and not PAST.search(s):
            note("error", 1.0, s)
        if SCRIPT.search(s):
            note("script", 2.0, s)
    return out, said, min(1.0, len(set(said)) / max(1, total))


def overlap(text: str, slug: str | None) -> float:
    """Share of title and slug terms that the rest of the text repeats; 1 where there is none."""
    head, _, rest = text.partition("\n")
    terms = {w.lower() for w in WORD.findall(head if rest.strip() and len(head) < 80 else "") if len(w) > 3}
    terms |= {w.lower() for w in WORD.findall((slug or "").replace("_", " ")) if len(w) > 3}
    if not terms:
        return 1.0
    body = {w.lower() for w in WORD.findall(rest or text)}
    return len(terms & body) / len(terms)


def skeleton(text: str) -> str:
    """The text without what varies between copies of one page: numbers, ids, case and space."""
    return " ".join(SKELETON.sub("#", text.lower()).split())


def scored(items: DataFrame) -> DataFrame:
    """The rows with any evidence: item_id, host, kind, points, share of the sentences, mismatch, information, hash of the phrases."""
    schema = "item_id string, host string, kind string, points double, share double, mismatch double, n_terms int, page bigint"

    def run(batch: pa.RecordBatch):
        import xxhash

        mask = pc.fill_null(pc.match_substring_regex(batch.column(3), PREFILTER), False)
        for item, host, link, body in zip(*(c.to_pylist() for c in batch.filter(mask).columns)):
            kinds, said, share = evidence(body)
            if kinds:
                kind = max(kinds, key=kinds.get)
                parts = (link or "").rstrip("/").split("/")
                slug = parts[-2] if len(parts) > 3 else ""
                bones = skeleton(" ".join(said))
                yield item, host, kind, kinds[kind], share, 1 - overlap(body, slug), len(set(WORD.findall(body.lower()))), xxhash.xxh64_intdigest(bones) - (1 << 63)

    names = [x.split()[0] for x in schema.split(", ")]
    return map_batches(spread(items.select("item_id", "subreddit", "permalink", "body")), run, schema, names)


def totals(items: DataFrame, copies: int = 3, terms: int = 40, mismatch: float = 0.5) -> DataFrame:
    """The scored rows with ``total`` points of all evidence, and what it is made of."""
    rows = cut_lineage(scored(items))
    pages = rows.groupBy("page").agg(F.approx_count_distinct("item_id").alias("copies"), F.approx_count_distinct("host").alias("hosts"))
    both = rows.join(pages, "page")
    point = lambda c, n=1.0: F.when(c, n).otherwise(0.0)
    total = F.col("points") + point(F.col("share") >= 1) + point(F.col("copies") >= copies) + point((F.col("copies") >= copies) & (F.col("hosts") > 1), 0.5)
    return both.withColumn("total", total + point((F.col("mismatch") >= mismatch) & (F.col("n_terms") <= terms)))


def found(items: DataFrame, least: float = 2.0) -> DataFrame:
    """Items with residue: ``item_id``; those with a row of at least ``least`` points in all."""
    return totals(items).filter(F.col("total") >= least).select("item_id").distinct()


#: Flagged ids up to this many (some 30 MB) are broadcast; more are joined by a shuffle.
SMALL = 1_000_000


def clean(items: DataFrame) -> DataFrame:
    """The history without the items that hold residue; rows without an item_id stay.

    The flagged ids are counted before they are broadcast, so bodies are shuffled only where too many
    items are flagged; rows without an id then stay out of the join.
    """
    gone = cut_lineage(found(items).filter("item_id is not null"))
    if gone.count() <= SMALL:
        return items.join(F.broadcast(gone), "item_id", "left_anti").select(items.columns)
    kept = items.filter("item_id is not null").join(gone, "item_id", "left_anti").select(items.columns)
    return kept.unionByName(items.filter("item_id is null"))
