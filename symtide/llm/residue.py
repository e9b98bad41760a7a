"""Template residue, filler and error-page texts.

Method: every line of a text is a message. Numbers, addresses, dates, paths and
identifiers in it are masked, exact hashes of the masked messages are grouped over
the whole corpus to see across how many sources they recur, and messages are
classified by phrase and placeholder rules; messages that only sound like notices
count as such when they recur widely. A document is a case if it holds residue and
nothing but residue, headings, menus and footers. What only sounds like a notice is
residue for that too where it stands beside listed residue in widely spread documents;
recurrence alone makes none, as sentences of content recur as widely.

Defined results: null and blank texts are no cases; a text with one line of content
is none; texts are judged as wholes; repeated rows each count (doc_id once); a null
source counts as one source of its own.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

#: Sources in which a message that only sounds like a notice must recur to count as one.
WIDE = 3
#: What a short message is: a longer one is no notice that nobody listed, but content.
SHORT_WORDS, SHORT_CJK = 14, 40

CONTENT, NEUTRAL, RESIDUE, MAYBE = 0, 1, 2, 3

_TAG = re.compile(r"(?i)</?(?:h[1-6]|p|ul|ol|li|br|hr|div|span|b|i|em|strong|a|table|tr|td|th|html|body|head|nav|footer|header|section|main|pre)(?:\s[^<>]*)?/?>")
_DECOR = re.compile(r"^(?:[\s*/>|=+~-]|#(?!\{)|//+!?)+|(?:\s|\*+/)+$")
_SLOT = re.compile(
    r"\{\{\s*[^\W\d][\w .-]*\}\}|\$\{\s*[^\W\d][\w .-]*\}|\$\(\s*[^\W\d][\w .-]*\)|%\([^\W\d][\w ]*\)[sdifSDIF]|(?<!\w)%[A-Za-z][A-Za-z_ ]*[A-Za-z]%"
    r"|(?<![\w@])@[A-Za-z][A-Za-z_]*[A-Za-z]@|(?<!\w)__[A-Za-z][A-Za-z]*(?:_[A-Za-z]+)*__|<%=?\s*[^\W\d][\w .-]*%>|#\{\s*[^\W\d][\w .-]*\}|\[\[\s*[^\W\d][\w .-]*\]\]"
    r"|(?i:\[\s*(?:insert|enter|add|your|type)\b[^\[\]]*\])|<(?!(?:BR|UL|OL|LI|HR|TD|TR|TH|DIV|SPAN|STRONG|EM|TABLE|HTML|BODY|HEAD|NAV|FOOTER|HEADER|SECTION|MAIN|PRE)>)[A-Z][A-Z]+(?:[_ -][A-Z]+)*>|(?i:<(?:your|insert|enter|fill)\b[^<>]*>)"
)
_CODE = re.compile(r"(?i)^\s*#\s*include\b|[;{}]\s*$|^\s*(?:class|struct|public|private|protected|namespace|template|using)\b.*[:{;>]\s*$|^\s*\w+(?:::\w+)+\(|^\s*(?:error|warning|note):|:\d+:\d+:|^\s*```")
_WORD = re.compile(r"[^\W_]+")
_CJK = re.compile(r"[㐀-鿿]")

#: The words of the usual filler text.
LOREM = frozenset(
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum".split()
)

_ANY = r".{1,80}?"

#: Sentences of filler and of unfilled pages.
_FILLER = [
    r"(?:(?:blah|asdf|qwerty|foo|bar|baz|test|x{3,}|y{3,}|z{3,}|tbd|n/?a|lorem|dummy|placeholder)[\s,.;-]*)+",
    r"(?:please )?replace (?:me|this(?: text)?)|(?:your|some|sample|dummy|example|placeholder|default) (?:text|paragraph|content|title|description|heading)(?: (?:goes )?here)?|(?:your |insert |enter |add |put )?(?:text|content|description)(?: goes)? here|placeholder(?: paragraph| text)?",
    r"(?:content|more|details|documentation|description|text|page) (?:is )?(?:coming soon|to follow|to be (?:added|written|done|announced)|will follow)|coming soon|to be (?:added|written|done|documented)|nothing here yet",
    r"(?:this|the) page (?:is |was |has been )?(?:intentionally|deliberately) (?:left )?(?:blank|empty)",
    r"(?:write|enter|add|insert|describe|put|say) (?:something|some text|a|an|the|your)\b.{0,40}?\b(?:here|class|function|file|module|project|page|description)(?: here)?|(?:enter|insert|add) .{1,40} here|(?:detailed|brief|short) description|(?:class|new|my|some|the)\s?(?:class|name|file|function|module)(?: ?name)?",
    r"@?author:? (?:your name(?: here)?|name(?: <mail>)?|unknown(?: author)?|todo)(?: <?e?-?mail>?)?|@?date:? (?:yyyy[-/.]mm[-/.]dd|dd[-/.]mm[-/.]yyyy|mm[-/.]dd[-/.]yyyy)|@?(?:version|since):? (?:x\.y(?:\.z)?|0\.0\.0)",
    r"(?:todo|tbd|fixme|xxx)\b[\s:,-]*(?:[^\W_]+[\s,.]*){0,4}",
    r"(?:[\w:]+\s*[:=]\s*)?(?:(?:undefined|null|none|nan|nil|n/a|\(null\)|\[?object object\]?|invalid date|<empty>)[\s,;.]*)+",
    r"(?:(?:nan|undefined|null|none) [^\W_]+,? ?)+(?:last (?:changed|modified|updated) (?:on|at|by) )?(?:invalid date|undefined|null|nan|none)",
]

#: Sentences of error pages and notices, in the languages of the corpus.
_NOTICES = [
    r"(?:http(?: status)?|error|fehler|erreur|status|errore|código|code)?[ :#-]*[45]\d\d\b(?:[ :,-]+(?:[^\W\d_]+['’ -]*){0,4})?",
    r"(?:the )?(?:page|file|document|site|url|resource|class|address)?\s*(?:was |is |could )?not (?:be )?found",
    r"(?:bad (?:request|gateway)|unauthori[sz]ed|forbidden|(?:internal )?server error|service (?:temporarily )?unavailable|gateway time-?out|method not allowed|gone|access (?:is )?denied|permission denied|request timed? ?out|too many requests)",
    rf"nothing (?:matches|was found (?:at|for)) {_ANY}|(?:the )?(?:requested |given )?(?:page|url|address|file|document|resource|link|path)\b{_ANY}(?:could not be (?:located|found|opened|loaded|displayed)|was not found|does not exist|no longer exists|cannot be found)(?: on this server| here)?",
    rf"we (?:have )?looked everywhere,? but {_ANY} (?:is|was) not here|(?:please )?(?:return|go back|back) to the (?:start|home|main)\s?page(?: or use the search(?: box)?)?|(?:please )?use the search(?: box)?|check the (?:address|url|spelling)(?: and try again)?",
    rf"the (?:class |file |api )?(?:reference|page|document|entry|documentation)(?: for {_ANY})? (?:has been|was|is) (?:moved|deleted|removed|withdrawn)(?: or (?:moved|deleted|removed))?",
    rf"you (?:do not|don't) have (?:the )?(?:permission|rights?|access) to {_ANY}|(?:please )?ask the owner for access|(?:please )?(?:sign|log) in(?: again)? to (?:see|view|continue|access|open|use)\b.{{0,60}}?|your session has (?:expired|timed out)|this (?:page|repository) is private|authentication (?:is )?required",
    r"too many requests.{0,40}?|(?:please )?slow down(?: and (?:retry|try again))?|(?:rate|request|usage|quota) limit (?:was |has been |is )?(?:exceeded|reached)|(?:please )?(?:try|retry)(?: again)?(?: (?:in|after) (?:\d+|a few|some) \w+| later)",
    rf"(?:please )?(?:enable|activate|turn on|allow) (?:javascript|scripts?|scripting|cookies)\b.{{0,80}}?|(?:you need to|you must|you have to) (?:enable|activate|turn on|allow) (?:javascript|scripts?|cookies)\b.{{0,80}}?|(?:javascript|scripts?|scripting|cookies) (?:is|are|must be|has been) (?:disabled|required|blocked|not (?:enabled|available)|turned off|enabled)\b.{{0,60}}?|(?:this|the) {_ANY} (?:requires?|needs?) (?:javascript|scripts|scripting|cookies)\b.{{0,40}}?|(?:please )?turn it on in your (?:browser )?settings(?: and reload)?|your browser (?:does not|doesn't|cannot|can't) {_ANY}|your browser is (?:out of date|not supported)|the [\w ]{{1,40}} (?:cannot|can not|can't|could not) be (?:shown|displayed|loaded|rendered|opened)",
    r"loading(?:\s*(?:…|\.{2,}))?|please wait(?:\s*(?:…|\.{2,}))?",
    rf"oops|(?:oops[,!. ]*)?something went wrong(?: on our (?:side|end))?|(?:the|our) (?:\w+ )?server (?:met|encountered|hit) {_ANY}(?: while {_ANY})?|an? (?:upstream|internal|unexpected|unknown) (?:service|error|problem|server)\b{_ANY}|(?:the|our) (?:[\w-]+ ){{0,3}}(?:server|service|site) is (?:temporarily |currently )?(?:unable to {_ANY}|unavailable|down|overloaded|offline)\b.{{0,60}}?|we have been notified(?: and are looking into it)?|we are (?:looking into it|working on (?:it|the problem))|\w*error: ['\"‘’]?[\w.:]+['\"‘’]? is (?:undefined|not defined)",
    r"(?:the|this|our) (?:[\w-]+ )?(?:site|page|server|service|wiki) is (?:down|closed|offline|unavailable|under (?:construction|maintenance))\b.{0,60}?|(?:this (?:page|site) is )?under (?:construction|maintenance)\b.{0,40}?|down for maintenance\b.{0,40}?|scheduled maintenance\b.{0,40}?",
    r"moved(?: permanently| temporarily)?|found|you (?:will be|are being) redirected\b.{0,40}?|redirecting\b.{0,40}?|if you are not redirected\b.{0,60}?",
    r"checking your browser\b.{0,60}?|this (?:may|can|will) take \d+ \w+|(?:please )?(?:prove|verify|confirm) that you are (?:a )?(?:human|not a robot)\b.{0,60}?|(?:please )?(?:type|enter) the \d+ (?:letters|characters|digits)\b.{0,40}?",
    # German, Spanish, French
    rf"(?:die )?seite (?:wurde )?nicht gefunden|(?:die|das|der) (?:datei|seite|dokument|klasse)\b{_ANY}(?:existiert nicht(?: mehr)?|wurde (?:verschoben|gelöscht|nicht gefunden)(?: oder (?:verschoben|gelöscht))?)|bitte aktivieren sie javascript\b.{{0,80}}?|javascript (?:ist|muss)\b.{{0,60}}?|(?:interner )?serverfehler\b.{{0,80}}?|bitte versuchen sie es\b.{{0,40}}?|zugriff (?:verweigert|abgelehnt)\b.{{0,80}}?|keine berechtigung\b.{{0,60}}?|diese seite (?:ist|wird)\b.{{0,60}}?|im aufbau|inhalt folgt(?: in kürze)?",
    rf"página no encontrada|(?:el|la) (?:documento|página|archivo|clase)\b{_ANY}(?:no existe|no se (?:ha )?encontr(?:ó|ado|ada)|ha sido (?:movid[oa]|eliminad[oa]))|(?:debe|por favor,?|tiene que|es necesario) (?:habilit(?:ar|e)|activ(?:ar|e)) javascript\b.{{0,80}}?|acceso (?:denegado|prohibido)\b.{{0,80}}?|error (?:interno )?del servidor\b.{{0,80}}?|(?:por favor,? )?(?:inténtelo|intente|vuelva a intentarlo)\b.{{0,60}}?|(?:sitio|página) en (?:construcción|mantenimiento)|próximamente",
    rf"page (?:introuvable|non trouvée)|(?:le|la|l')\s?(?:document|page|fichier|classe)\b{_ANY}(?:n['’]existe (?:pas|plus)|est introuvable|a été (?:déplacée?|supprimée?))|veuillez (?:activer javascript|réessayer|patienter)\b.{{0,80}}?|javascript (?:est|doit)\b.{{0,60}}?|accès (?:refusé|interdit)\b.{{0,80}}?|erreur (?:interne )?(?:du serveur)?\b.{{0,80}}?|(?:site|page) en (?:construction|maintenance)|bientôt disponible",
    # Chinese
    r".{0,40}?(?:页面(?:未找到|不存在|找不到)|找不到(?:该|此|您)?.{0,20}?(?:页面|文件|文档)|(?:文档|文件|页面|类).{0,40}?(?:不存在|已被(?:移动|删除|移除))|(?:请|需要|必须)(?:先)?(?:启用|开启|打开).{0,10}?javascript|访问(?:被拒绝|受限)|(?:没有|无)权限?(?:访问|查看|打开)|拒绝访问|服务器(?:内部)?错误|内部服务器错误|服务(?:暂时|暂)?不可用|请(?:稍后|稍候)(?:再试|重试)?|请求过于频繁|正在(?:维护|建设|加载)|建设中|敬请期待|请(?:先)?登录).{0,60}?",
]

#: Headings, menus, footers and greetings around such texts.
_AROUND = [
    r"skip to (?:main )?(?:content|navigation)|back to top|(?:go )?to top|menu|search|home|contents|navigation|top|next|previous|print|share",
    r"(?:[^\W_]+(?: [^\W_]+)?\s*[|»>·•/]\s*)+[^\W_]+(?: [^\W_]+)?",
    r"(?:©|\(c\)|copyright)\s.{0,60}|all rights reserved|powered by .{1,40}|(?:last )?(?:updated|modified|generated)(?: on| at)?:? [\d./: -]+",
    r"(?:doc )?server node \d+|(?:reference|request|incident|error|trace|ray)[ -]?(?:id|number|code)?[ :#]+[0-9a-f-]{4,}|(?:we|this site) uses? cookies\b.{0,60}",
    r"(?:(?:best|kind|with kind) )?regards|thanks|thank you|cheers|sincerely|yours|(?:hi|hello|dear)(?: all| team| reader)?",
]

#: A short message with one of these words may be a notice nobody listed (English, German, Spanish, French, Chinese); for lower case.
_CUE = re.compile(
    r"\b(?:try again|unavailable|browser|javascript|cookies|sign in|log in|administrator|webmaster|reload|maintenance|redirect\w*|captcha|robot|expired|denied|forbidden|support team|contact us|apologi[sz]e|sorry|temporarily"
    r"|erneut|nicht verfügbar|nicht erreichbar|anmelden|einloggen|wartung\w*|weitergeleitet|abgelaufen|gesperrt|verweigert|leider|entschuldig\w*|vorübergehend"
    r"|inténtelo|no disponible|navegador|sesión|administrador|mantenimiento|redirig\w*|caducad[oa]|expirad[oa]|denegad[oa]|prohibid[oa]|lo sentimos|disculp\w*|temporalmente"
    r"|réessay\w*|indisponible|navigateur|connecter|connectez|administrateur|expirée?|refusée?|interdite?|désolés?|excus\w*|temporairement)\b"
    r"|浏览器|登录|管理员|维护|稍后|稍候|重试|过期|拒绝|抱歉|暂时|跳转|验证码"
)


def _full(parts: list[str]) -> re.Pattern:
    return re.compile(r"(?is)(?:" + "|".join(parts) + r")")


_FILLER_RE, _NOTICE_RE, _AROUND_RE = _full(_FILLER), _full(_NOTICES), _full(_AROUND)
_SENTENCE = re.compile(r"(?<=[.!?…])\s+|\s+\|\s+|(?<=[。！？])\s*|:\s+(?=please\b)", re.I)
_EDGE = re.compile(r"^[\s\"'“”‘’*_`(\[.:!-]+|[\s\"'“”‘’*_`)\].,:;!?。！？-]+$")


def masked(line: str) -> str:
    """A message without what varies: numbers, addresses, dates, paths and identifiers."""
    m = re.sub(r"(?i)\bhttps?://\S+|\b[\w.+-]+@[\w-]+\.\w+", "<addr>", line)
    m = re.sub(r"\b[\w.-]+(?:/[\w.-]+)+\b|\b\w+(?:::\w+)+|\b\w+\.(?:h|hpp|hh|cc|cpp|cxx|py|js|html?)\b", "<path>", m)
    m = re.sub(r"\b(?:[A-Z][a-z0-9]+){2,}\b|\b[a-z]+(?:[A-Z][a-z0-9]*)+\b|\b[0-9a-f]{8,}\b", "<name>", m)
    m = re.sub(r"\d+(?:[.,:/-]\d+)*", "0", m)
    return re.sub(r"\s+", " ", m).strip().lower()


def line_hash(line: str) -> int:
    """64 bits of the masked message."""
    return int.from_bytes(hashlib.blake2b(masked(line).encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True)


def _sentence(s: str) -> int:
    bare = _EDGE.sub("", s)
    if not bare:
        return NEUTRAL
    if _FILLER_RE.fullmatch(bare) or _NOTICE_RE.fullmatch(bare):
        return RESIDUE
    words = [w.lower() for w in _WORD.findall(bare)]
    if len(words) >= 3 and sum(w in LOREM for w in words) >= 0.8 * len(words):
        return RESIDUE
    if _AROUND_RE.fullmatch(bare):
        return NEUTRAL
    if re.fullmatch(r"[A-Za-z_]\w*(?:(?:::|/)\w+)*(?:\.\w+)?", bare) and (not bare.islower() or "_" in bare or "/" in bare):
        return NEUTRAL  # the name of a class or file alone: a title
    if len(words) <= SHORT_WORDS and len(_CJK.findall(bare)) <= SHORT_CJK and _CUE.search(bare.lower()):
        return MAYBE
    return CONTENT


def judge(line: str) -> int:
    """The class of one line by rules alone."""
    raw = line.strip()
    heading = re.match(r"#{1,6}\s+\S", raw) is not None
    if raw.startswith("```"):
        return CONTENT
    bare = _DECOR.sub("", _TAG.sub(" ", raw)) if not _SLOT.fullmatch(raw) else raw
    if raw.startswith("#{"):
        bare = _TAG.sub(" ", raw).strip()
    if not bare:
        return CONTENT if raw in ("}", "{", "};") else NEUTRAL
    slots = _SLOT.findall(bare)
    if slots and not re.match(r"(?i)\s*#\s*include\b", raw):
        rest = _WORD.findall(_SLOT.sub(" ", bare))
        return RESIDUE if len(rest) <= (4 * len(slots) + 1 if len(slots) > 1 else 3) else CONTENT
    if (whole := _sentence(bare)) in (RESIDUE, NEUTRAL):
        return whole
    if _CODE.search(raw):
        return CONTENT
    if heading and len(_WORD.findall(bare)) <= 5 and not _CJK.search(bare):
        return NEUTRAL
    got = set()
    for s in _SENTENCE.split(bare):
        if s.strip():
            got.add(_sentence(s))
            if CONTENT in got:
                return CONTENT
    return MAYBE if MAYBE in got else RESIDUE if RESIDUE in got else NEUTRAL


def messages(documents: DataFrame) -> DataFrame:
    """(doc_id, source, line_hash, kind, open, beside): the messages that can decide about a document.

    ``beside``: listed residue stands in the document, and no content. Of documents with a line of content only the maybe-lines come out (``open``
    false): they count for how widely a message recurs.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, tuple[int, int]] = {}
        for b in batches:
            out = []
            for doc, source, text in zip(b["doc_id"], b["source"], b["text"]):
                rows, whole = {}, True
                for line in re.split(r"[\r\n]+", text):
                    if not line.strip() or not whole and not _CUE.search(line.lower()):
                        continue  # once there is content, only a notice nobody listed is of interest
                    got = known.get(line)
                    if got is None:
                        kind = judge(line)
                        if len(known) > 100_000:
                            known.clear()
                        got = known[line] = (kind, line_hash(line) if kind in (RESIDUE, MAYBE) else 0)
                    if got[0] == CONTENT:
                        whole = False
                    elif got[0] != NEUTRAL:
                        rows[got[1]] = got[0]
                beside = whole and RESIDUE in rows.values()
                out += [(doc, source, h, k, whole, beside) for h, k in rows.items() if whole or k == MAYBE]
            yield pd.DataFrame(out, columns=["doc_id", "source", "line_hash", "kind", "open", "beside"])

    texts = documents.select("doc_id", "source", "text").filter(F.col("text").isNotNull())
    return texts.mapInPandas(run, "doc_id long, source string, line_hash long, kind int, open boolean, beside boolean")


def residue_documents(documents: DataFrame, wide: int = WIDE) -> DataFrame:
    """(doc_id, n_messages, n_sources) of the documents that are residue as a whole."""
    got = materialize(messages(documents), "messages")  # the corpus is read and judged once
    # Two steps, so a message of very many documents is counted without gathering them.
    spread = got.groupBy("line_hash", F.coalesce("source", F.lit("")).alias("source")).agg(F.max("beside").alias("beside")).groupBy("line_hash").agg(F.count(F.lit(1)).alias("n_sources"), F.count(F.when(F.col("beside"), 1)).alias("n_beside"))
    judged = got.filter("open").join(spread, "line_hash")
    ok = (F.col("kind") == RESIDUE) | (F.col("n_sources") >= wide)
    sure = (F.col("kind") == RESIDUE) | (F.col("n_beside") >= wide)
    return judged.groupBy("doc_id").agg(F.min(ok.cast("int")).alias("all_ok"), F.max(sure.cast("int")).alias("any_sure"), F.count(F.lit(1)).alias("n_messages"), F.max("n_sources").alias("n_sources")).filter("all_ok = 1 AND any_sure = 1").select("doc_id", "n_messages", "n_sources")


def recurring_messages(documents: DataFrame) -> DataFrame:
    """(line_hash, kind, n_docs, n_sources): the report of the message groups."""
    got = messages(documents).groupBy("line_hash", "kind", F.coalesce("source", F.lit("")).alias("source")).agg(F.count(F.lit(1)).alias("n"))
    return got.groupBy("line_hash", "kind").agg(F.sum("n").alias("n_docs"), F.count(F.lit(1)).alias("n_sources"))
