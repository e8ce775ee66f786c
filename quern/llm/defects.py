"""Broken prompt and response pairs: empty, truncated, refused, copied, and answered in another language."""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.tables import bloom, passes
from quern.runtime import Stash

BLANKS = " \t\r\n"

#: Placeholders that stand for no answer, without brackets and in lower case. Fixed values.
PLACEHOLDERS = frozenset((
    "n/a", "na", "n.a.", "nan", "nil", "null", "none", "none given", "no answer", "no answer given", "not available", "not applicable",
    "not given", "no response", "tbd", "tba", "tbc", "todo", "to do", "fixme", "empty", "blank", "missing", "undefined", "placeholder", "xxx",
    "keine angabe", "k.a.", "keine antwort", "leer", "offen", "entfällt",
    "sans réponse", "pas de réponse", "aucune réponse", "vide", "à compléter", "s.o.", "s/o",
    "sin respuesta", "sin contestar", "ninguna respuesta", "vacío", "pendiente", "por definir", "n/d",
))

#: Function words by which a language is told; each stands in one language only. Fixed values.
FUNCTION_WORDS = {
    "en": "the and of is are was were to that this these those with from by for not when if so it its they which what how why who where does did do may can but than into only both each every has have had been at on or as while after before until once under between without there their".split(),
    "de": "der die das und ist sind wird wurde den dem des ein eine einer einem einen mit von zu auf für nicht wenn dass bei nach aus sich wie wo wer warum darf kann aber als auch nur jede jeder über unter zwischen ohne sobald obwohl falls während wann welche vor zum zur sie es wirkte führt".split(),
    "fr": "le les des une du et est sont dans par pour pas sur au aux ce cette ces il elle qui où dont quand avec sans mais ou ne si à combien comment pourquoi quelle quel que sa ses leur entre depuis après dès lorsque tandis chaque plutôt rien faut peut d l n s c qu j m".split(),
    "es": "el los las una del y está son con por para no sobre al este esta cuando sin pero o si cuántas cómo cuál qué quién dónde su sus entre desde tras hasta donde aunque mientras cada así nada poco más lo se le hay ser como todos en es".split(),
}
#: The same for languages that the corpus may have too little of to learn from.
MORE_FUNCTION_WORDS = {
    "it": "il gli della delle degli nella che è sono anche questo perché dopo ogni alla dalla",
    "pt": "os uma não são com também isso pelo pela dos das nas ao foi muito você em",
    "nl": "het een van niet zijn voor wordt maar ook naar uit deze omdat nog heeft geen",
    "sv": "och att det som är för inte på av till har när efter eller från varje",
    "da": "og ikke af til efter hver når blev jeg været også fra",
    "pl": "nie się jest że jak przez dla czy oraz przed gdy który są jako po",
    "tr": "ve bir bu için ile çok daha gibi ama her sonra değil olarak",
    "ro": "și este în nu cu pe din care sunt pentru mai după fiecare",
    "fi": "ja on ei että oli mutta kun niin kuin jos myös ovat tai joka",
    "id": "yang dan ini itu dengan untuk tidak dari pada adalah akan setelah oleh",
}
#: Words of the lists above that other languages share, and so tell nothing.
SHARED = frozenset("no en es se si o que le des son la de un an in so was die war as on do sin an has par me por ne".split())

#: What declining is made of, by language. Fixed values.
#: me: who speaks; unable: what is denied, or the verb that denies; act: answering, or what is asked for; said: declining that names
#: the request instead of the speaker, or needs no act.
DECLINING = {
    "en": {
        "me": r"I(?!/)|I['’](?:m|d|ll|ve)|we|we['’](?:re|d|ll|ve)|me|us|my",
        "unable": r"cannot|can ?not|can['’]?t|could not|couldn['’]?t|won['’]t|will not|would not|wouldn['’]t|unable|not (?:be )?able|not allowed|not permitted|not possible|not going|not willing|not in a position|not comfortable|not at liberty|unwilling|impossible|incapable|declin\w+|refus\w+|rather not|prefer not|no way|beyond (?:me|my)",
        "act": r"answer\w*|respond\w*|reply|comply|assist\w*|help(?=\s(?:you|with|here|on|out)|\W*$|[.,;!])|disclos\w*|comment\w*|fulfil\w*|oblige|advise|elaborate|weigh in|discuss\w*|(?:talk|speak) (?:about|of|on)|(?:provid\w*|shar(?:e|ing)|giv(?:e|ing)|tell|say|reveal\w*|support\w*|process\w*|offer\w*|talk|speak|go into|continue|engage|handle|address|generate|write|produce|do)\b[^.]{0,30}?\b(?:that|this|you|such|any|anything|information|details?|answers?|advice|requests?|content|topic|questions?|subject|those|these|about)",
        "said": r"not something (?:I|we)\b|\b(?:I|we) (?:do not|don['’]t|have no|lack|haven['’]t|have not) ?(?:have |been given |the )?(?:access|permission|authori[sz]ation|the (?:ability|information|documents?|passages?|clearance)|enough (?:information|context)|any (?:information|details))\b|\b(?:this|that|your|such an?) (?:request|question|query|prompt|inquiry|topic)\b.{0,30}(?:(?:cannot|can['’]t|can not|could not|won['’]t|will not) be|(?:is|was|has been|must be) (?:declined|refused|rejected|denied)|is (?:off limits|beyond|outside))|\bno (?:answer|comment|information|details?) (?:can|will|may) be (?:given|provided|shared)|^no comment\b|\bI(?:['’]ll| must| have to| will) (?:pass|decline)(?= on| this| here|\W|$)",
    },
    "de": {
        "me": r"ich|wir|mir|uns|mich",
        "unable": r"(?:kann|können|könnte|darf|dürfen|möchte|möchten|werde|werden|will|wollen|vermag|imstande|lage|möglich|kein\w*|habe|haben)\b.{0,80}\b(?:nicht|nichts|kein\w*|verzicht\w*)|nicht (?:möglich|befugt|berechtigt|erlaubt|gestattet|imstande|in der lage)|kein\w* zugriff|ablehn\w*|abzulehnen|abgelehnt|lehne|lehnen|verweiger\w*|unmöglich|außerstande|passen|absehen",
        "act": r"\w*antwort\w*|helfen|weiterhelfen|behilflich|unterstütz\w*|sagen|äußern|mitteilen|auskunft|preisgeben|weitergeben|nachkommen|bearbeit\w*|bereitstellen|nennen|anfrage\w*|zugriff|eingehen|dienen|(?:angaben|informationen|details|einzelheiten|stellung|rat)\b.{0,30}\b(?:geben|machen|nehmen|herausgeben|teilen)|(?:geben|machen|herausgeben|teilen)\b.{0,20}\b(?:angaben|informationen|details)",
        "said": r"\b(?:diese[rs]?|ihre[rm]?|deine[rm]?|solche[rn]?|der|einer solchen) (?:anfrage|frage|bitte)\b.{0,60}\b(?:abgelehnt|verweigert|zurückgewiesen|nicht (?:beantwort\w*|bearbeit\w*|erfüll\w*|nach\w*|möglich|entspr\w*))|\bauskunft\b.{0,40}\b(?:nicht (?:erteilt|möglich|gegeben)|verweigert)|\bmir (?:leider )?nicht möglich\b|\bda(?:zu|rüber|rauf)\b.{0,30}\b(?:keine (?:auskunft|antwort|angaben|aussage)|nichts sagen)|\bda(?:rauf)? muss ich (?:leider )?passen",
    },
    "fr": {
        "me": r"je|j|nous|m|me|moi",
        "unable": r"n(?:e|['’])\b.{0,50}\b(?:pas|point|rien|aucune?|plus)|impossible|incapables?|refus\w+|déclin\w+|préf\w+ ne pas|ne pas pouvoir|hors de question|abstenir\w*|abstiens",
        "act": r"répon\w+|aider|assister|fournir|communiquer|divulguer|commenter|renseigner|prononcer|accéder|accès|satisfaire|traiter|dire|demande|parler d\w*|(?:donner|partager|apporter)\b.{0,30}(?:répon\w+|inform\w+|détails?|suite|avis|cela|aide)",
        "said": r"\b(?:cette|votre|ta|une telle|la présente) (?:demande|question|requête)\b.{0,50}\b(?:ne (?:peut|sera|saurait|pourra)|est (?:refusée|rejetée|déclinée)|a été (?:refusée|rejetée)|reste sans)|\bimpossible d['’](?:y )?(?:répondre|accéder|apporter|en dire)|\bil n['’]est pas possible de (?:répondre|fournir|donner|traiter)|\baucune (?:réponse|information) ne (?:peut|sera)\b",
    },
    "es": {
        "me": r"yo|me|mí|nos|puedo|podemos|podré|podremos|podría|podríamos|debo|debemos|tengo|tenemos|prefiero|preferimos|quiero|queremos|estoy|estamos|lamento|lamentamos|rechazo|declino|voy|vamos|dispongo|soy",
        "unable": r"no (?:me |te |le |nos |os |se |lo |la )?(?:es posible|puedo|podemos|podré|podremos|podría|podríamos|debo|debemos|quiero|queremos|tengo|tenemos|dispongo|estoy|estamos|voy|vamos|soy capaz|resulta posible)|imposible|rechaz\w+|declin\w+|negar\w*|niego|prefer\w+ no|prefiero no|abstener\w*|abstengo",
        "act": r"respond\w+|respuesta|contest\w+|ayud\w+|asist\w+|proporcion\w+|facilit\w+|coment\w+|atender\w*|solicitud|petición|acceso|decir\w*|revelar\w*|opinar|cumplir|hablar (?:de|sobre)|(?:dar\w*|compart\w+|ofrecer\w*)\b.{0,30}(?:respuesta|información|detalles?|datos?|eso|esto|consejo)",
        "said": r"\b(?:esta|su|tu|esa|tal|dicha|la presente) (?:solicitud|pregunta|petición|consulta)\b.{0,40}\b(?:no (?:se )?(?:puede|podrá|será|es posible|procede)|(?:ha sido|queda|es|está|fue) (?:rechazada|denegada|desestimada))|\bno (?:es posible|se puede) (?:responder|contestar|atender|proporcionar|facilitar|dar)|\bno (?:puedo|podemos) (?:hacerlo|hacer eso|con eso)",
    },
}
#: Words that an apology is made of; a sentence of nothing else is passed over.
APOLOGY = frozenset("sorry i i'm i’m am very so really my apologies apologize apologise unfortunately regrettably hello hi thanks thank you for asking no oh leider entschuldigung entschuldigen sie bitte tut mir es sehr leid nein verzeihung désolé désolée navré navrée malheureusement pardon je suis excusez-moi non lo siento mucho perdón disculpa disculpe lamentablemente desgraciadamente".split())
#: Words that head a restated question, and abbreviations after which an answer isn't over. Fixed values.
LABELS = frozenset("answer a q question response reply frage antwort f réponse question r pregunta respuesta p".split())
OPEN_ENDS = ("e.g.", "i.e.", "cf.", "z.b.", "z. b.", "d.h.", "d. h.", "bzw.", "p.ex.", "p. ex.", "p.ej.", "p. ej.", "vs.", "approx.", "incl.")
#: How an instruction asks for a language, or for the input again. Fixed values.
ASKED_LANGUAGE = {
    "it": "italian|italienisch|italien|italiano", "pt": "portuguese|portugiesisch|portugais|portugués", "nl": "dutch|niederländisch|néerlandais|neerlandés", "sv": "swedish|schwedisch|suédois|sueco",
    "da": "danish|dänisch|danois|danés", "pl": "polish|polnisch|polonais|polaco", "tr": "turkish|türkisch|turc|turco", "ro": "romanian|rumänisch|roumain|rumano", "fi": "finnish|finnisch|finnois|finés",
    "id": "indonesian|indonesisch|indonésien|indonesio", "CYRILLIC": "russian|russisch|russe|ruso|ukrainian|bulgarian|serbian", "CJK": "chinese|chinesisch|chinois|chino|japanese|japanisch|japonais|japonés",
    "GREEK": "greek|griechisch|grec|griego", "ARABIC": "arabic|arabisch|arabe|árabe", "HANGUL": "korean|koreanisch|coréen|coreano", "HEBREW": "hebrew|hebräisch|hébreu|hebreo", "DEVANAGARI": "hindi",
    "en": "english|englisch|anglais|inglés", "fr": "french|französisch|français|francés", "de": "german|deutsch|allemand|alemán", "es": "spanish|spanisch|espagnol|español"}
ASKED_REPEAT = re.compile(r"\b(?:repeat|verbatim|word for word|echo|copy|restate|wiederhol\w*|wörtlich|répét\w*|mot pour mot|repite|repita|palabra por palabra)\b", re.I)

LANGUAGES = tuple(FUNCTION_WORDS)
_parts = re.compile(r"(?<=[.!?…])\s+|\n")
_LANGUAGES = {k: frozenset(v) - SHARED for k, v in FUNCTION_WORDS.items()}
_HINTS = {w: [k for k, words in _LANGUAGES.items() if w in words] for w in frozenset().union(*_LANGUAGES.values())}
_others = Counter(w for words in MORE_FUNCTION_WORDS.values() for w in words.split())
_MORE = {w: k for k, words in MORE_FUNCTION_WORDS.items() for w in words.split() if _others[w] == 1 and not any(w in v for v in FUNCTION_WORDS.values())}
_no_latin = regex.compile(r"[\p{L}--\p{Latin}]", regex.V1)
_DECLINING = {tongue: {k: regex.compile(v if k == "said" else rf"\b(?:{v})(?!\w)", regex.I) for k, v in parts.items()} for tongue, parts in DECLINING.items()}
_sentence = regex.compile(r"(?<=[.!?…][\"'”’»)\]]*)\s+(?=[\p{Lu}¿¡“«\"'(\[])|\n+")
_ASKED = {k: re.compile(rf"\b(?:{v})\b", re.I) for k, v in ASKED_LANGUAGE.items()}
_words = re.compile(r"[^\W\d_]+|\d[\d.,]*|%")
_letters = re.compile(r"[^\W\d_]+")
_marks = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "“”„«»‘’‚‹›¿¡…–—\u200b"
_invisible = regex.compile(r"[\s\p{Z}\p{C}\u034f\u115f\u1160\u17b4\u17b5\u180e\u3164\uffa0]+")
_quoted = re.compile("“[^”“]*”|«[^»«]*»|„[^“”„]*[“”]|\"[^\"]*\"|‘[^’‘]{2,}’(?!\\w)")
_fence = re.compile(r"```.*?(?:```|$)", re.S)
_citations = re.compile(r"(?:\s*\[Document \d+\])+\s*$")
_item = re.compile(r"^[ \t]*(?:[-*•+]|\d+[.)])[ \t]+(.*)$")
_ended = re.compile(r"[.!?。！？:;][\"'”’»)\]]*$")
_broken_off = re.compile(r"(?:\.\.|…|\[(?:\.{2,}|…)\])$|\n[ \t]*(?:[-*•+]|\d+[.)])$")
_sentence_ends = re.compile(r"[.!?…][\"'”’»)\]]*\s")
PHRASE_SHARE, PHRASE_VOTES, LONG_PHRASE, LONG_VOTES = 0.02, 1, 6, 5
"""A phrase is whole if at least this share, and this number, of the other distinct answers that begin like it end with it.
Beyond LONG_PHRASE words it takes LONG_VOTES, as two answers so alike may be one sentence cut at one place."""
COMMON_SHARES = (0.001, 0.0003)
"""Words of at least this share of the answers are common, more or less strictly; so they number at most a few thousand
times an answer's words."""
COMMON_FEW = 10
"""On small tables a name in a few answers would be common, and its phrases alike to none; so one more level asks for this many."""


def script(text: str) -> str | None:
    """The alphabet of most of a text's letters, if it isn't the Latin one; Chinese and Japanese count as one."""
    if text.isascii():
        return None
    found = _no_latin.findall(text)
    if 2 * len(found) <= sum(map(str.isalpha, text)):
        return None
    name = Counter(unicodedata.name(c, "?").split()[0] for c in found).most_common(1)[0][0]
    return "CJK" if name in ("CJK", "HIRAGANA", "KATAKANA") else name


def language(text: str) -> str | None:
    """The language whose function words a text has, if they are at least two and three times those of any other."""
    hits = Counter(k for w in _letters.findall(text.lower()) if w in _HINTS for k in _HINTS[w])
    best = max(LANGUAGES, key=lambda k: hits[k])
    return best if hits[best] >= 2 and all(hits[best] >= 3 * n for k, n in hits.items() if k != best) else None


def foreign(text: str) -> str | None:
    """A language outside FUNCTION_WORDS: by its alphabet, or by at least three function words, three times those of any other."""
    if found := script(text):
        return found
    words = _letters.findall(text.lower())
    hits = Counter(_MORE[w] for w in words if w in _MORE)
    if not hits:
        return None
    best, n = hits.most_common(1)[0]
    own = max(Counter(k for w in words if w in _HINTS for k in _HINTS[w]).values(), default=0)
    return best if n >= 3 and n >= 3 * own and all(n >= 3 * m for k, m in hits.items() if k != best) else None


class LanguageModel:
    """Naive Bayes over the common words of the corpus, as the function words label its texts; others by ``foreign``."""

    def __init__(self, counts: dict[str, list[int]]) -> None:
        sums = [sum(n[k] for n in counts.values()) for k in range(len(LANGUAGES))]
        self.scores = {w: [math.log((x + 0.1) / (t + 1)) for x, t in zip(n, sums)] for w, n in counts.items()}
        self.known = [(k, name) for k, name in enumerate(LANGUAGES) if sums[k]]

    def __call__(self, text: str, margin: float = 3.0) -> str | None:
        """The most probable language, if it leads by the margin; without a rival in the corpus, the function words decide."""
        if other := foreign(text):
            return other
        if len(self.known) < 2:
            return language(text)
        known = [self.scores[w] for w in _letters.findall(text.lower()) if w in self.scores]
        ranked = sorted(((sum(x[k] for x in known), name) for k, name in self.known), reverse=True)
        return ranked[0][1] if known and ranked[0][0] - ranked[1][0] >= margin else None

    def wholly(self, text: str) -> str | None:
        """The language of a text, if no sentence or line of it is in another one."""
        whole = self(text)
        parts = {self(x) for x in _parts.split(text)} - {None}
        return whole if parts <= {whole} else None


def is_empty(answer: str | None) -> bool:
    """Null, only blanks, invisible characters or marks, or a placeholder in any brackets."""
    bare = _invisible.sub(" ", answer or "").strip()
    if not regex.search(r"[\p{L}\p{N}]", bare):
        return True
    core = bare.strip("[](){}<>*_-–—\"'“”«» .!?:;").lower()
    return core in PLACEHOLDERS or bare.strip("[](){}<>").lower() in PLACEHOLDERS


def declines(sentence: str) -> bool:
    """A sentence in which the speaker denies to answer, or the request is denied; in English the act follows the denial."""
    for tongue, d in _DECLINING.items():
        denied = d["unable"].search(sentence)
        if denied and d["me"].search(sentence) and d["act"].search(sentence, denied.start() if tongue == "en" else 0) or d["said"].search(sentence):
            return True
    return False


def is_refusal(answer: str) -> bool:
    """The first sentence that isn't a mere apology declines to answer; quotations don't count."""
    for part in _sentence.split(_quoted.sub(" ", answer).strip()):
        words = part.lower().replace(",", " ").strip(" .!?…;:-").split()
        if not all(w.strip(".!?…;:") in APOLOGY for w in words):
            return declines(part)
    return False


def _common_order(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence; the rows of the usual table are the bits of a number."""
    at: dict[str, int] = {}
    for k, word in enumerate(b):
        at[word] = at.get(word, 0) | 1 << k
    full = left = (1 << len(b)) - 1
    for word in a:
        met = left & at.get(word, 0)
        left = (left + met | left - met) & full
    return len(b) - left.bit_count()


def is_copy(question: str | None, answer: str) -> bool:
    """The answer adds nothing to the question: with it as the dictionary it compresses to almost nothing.

    What compresses well is confirmed word by word: in order, labels aside, no other words and few lost ones.
    """
    if not question:
        return False
    q, a = ([w for x in t.casefold().split() if (w := x.strip(_marks))] for t in (question, answer))
    while a and a[0] in LABELS and a[0] != (q[0] if q else None):
        a = a[1:]
    if not q or len(a) < 0.6 * len(q) or len(q) < 2:
        return False
    data, prompt = " ".join(a).encode(), " ".join(q).encode()
    dictionary = zstandard.ZstdCompressionDict(prompt, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    size = len(zstandard.ZstdCompressor(1, dict_data=dictionary, write_content_size=False).compress(data))
    if size > 0.6 * len(data) + 12:
        return False
    times = max(1, round(len(a) / len(q)))
    same = _common_order(a, q * times)
    return same == len(a) and len(q) * times - same <= max(1, len(q) // 6) * times


def skeleton(text: str, common: frozenset[str]) -> list[str]:
    """The words of a phrase: common ones as they are, numbers as #, all others as one sign."""
    out = []
    for w in _words.findall(text.lower()):
        out.append("#" if w[0].isdigit() else w if w in common or w == "%" else "_")
    return out


def chain(level: int, words: list[str]) -> list[int]:
    """A key for each beginning of a phrase, from none of its words to all; ``level`` is that of its common words."""
    out = [level]
    for word in words:
        out.append(xxhash.xxh3_64_intdigest(word, seed=out[-1]))
    return [k - (1 << 63) for k in out]


def ending(answer: str) -> tuple[str, str]:
    """How an answer ends: (whole | cut | item | phrase, the text that decides)."""
    text = answer.strip()
    if text.count("```") % 2:
        return "cut", ""
    if text.endswith("```"):
        return "whole", ""
    text = _citations.sub("", text).rstrip() or text
    if re.search("[“„«]", _quoted.sub(" ", text)):
        return "cut", ""
    for opening, closing in ("()", "[]"):
        if text.count(opening) > text.count(closing) and text.find(closing, text.rfind(opening)) < 0:
            return "cut", ""
    if re.search(r"\([^()]*\)$", text) and (rest := text[: text.rfind("(")].rstrip()) and _ended.search(rest):
        return "whole", ""
    low = text.lower()
    if low.endswith(OPEN_ENDS) or _broken_off.search(text):
        return "cut", ""
    if re.search(r"[.!?。！？][\"'”’»)\]]*$", text):
        return "whole", ""
    if re.search(r"[,:;(\[{–—/&+=-]$", text):
        return "cut", ""
    last = text.split("\n")[-1]
    if m := _item.match(last):
        return "item", m.group(1).strip().lower()
    if "\n" in text.rstrip() or _sentence_ends.search(text):
        return "cut", ""
    return "phrase", text


def judge(question: str | None, answer: str | None, instruction: str | None, tongues: LanguageModel) -> tuple[str | None, str, str]:
    """(defect, how the answer ends, the text that decides); a defect of null with item or phrase needs the corpus."""
    if is_empty(answer):
        return "empty", "", ""
    if is_refusal(answer):
        return "refusal", "", ""
    if is_copy(question, answer):
        return (None if instruction and ASKED_REPEAT.search(instruction) else "copy"), "", ""
    how, decides = ending(answer)
    if how == "cut":
        return "truncated", how, decides
    prose = _quoted.sub(" ", _fence.sub(" ", answer))
    spoken, asked = tongues.wholly(prose), tongues(question or "")
    if spoken and asked and spoken != asked and not (instruction and spoken in _ASKED and _ASKED[spoken].search(instruction)):
        return "language", how, decides
    return None, how, decides


def sft_pairs(sft: DataFrame) -> DataFrame:
    """(tbl, id, question, answer, instruction): the question is input, or instruction where input is null or blank."""
    blank = F.coalesce(F.trim("input", F.lit(BLANKS)), F.lit("")) == ""
    return sft.select(F.lit("sft").alias("tbl"), "id", F.when(blank, F.col("instruction")).otherwise(F.col("input")).alias("question"), F.col("output").alias("answer"), F.when(~blank, F.col("instruction")).alias("instruction"))


def qa_pairs(train_qa: DataFrame) -> DataFrame:
    return train_qa.select(F.lit("train_qa").alias("tbl"), "id", "question", F.col("reference_answer").alias("answer"), F.lit(None).cast("string").alias("instruction"))


def _distinct(pairs: DataFrame, column: str) -> DataFrame:
    """(text, answer): the distinct texts of a column, give or take case and blanks, and whether they are answers."""
    same = F.lower(F.trim(F.regexp_replace(column, r"\s+", " "), F.lit(BLANKS)))
    texts = pairs.where(F.col(column).isNotNull()).groupBy(same.alias("same")).agg(F.min(column).alias("text"))
    return texts.select("text", F.lit(column == "answer").alias("answer"))


def common_words(answers: DataFrame, questions: DataFrame) -> tuple[tuple[frozenset[str], ...], dict[str, list[int]]]:
    """The words of at least each of COMMON_SHARES of the answers, and in how many texts of each language they are.

    Both are distinct texts, so that copies make no word common.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["word", "n", *LANGUAGES]
        for batch in batches:
            seen: dict[str, list[int]] = {}
            for text, own in zip(batch.column("text").to_pylist(), batch.column("answer").to_pylist()):
                told = language(_quoted.sub(" ", _fence.sub(" ", text)))
                for word in set(_letters.findall(text.lower())):
                    n = seen.setdefault(word, [0] * len(names[1:]))
                    n[0] += own
                    if told:
                        n[1 + LANGUAGES.index(told)] += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), *(pa.array([x[k] for x in seen.values()], pa.int64()) for k in range(len(names) - 1))], names)

    n = answers.count()
    schema = ", ".join(["word string", "n bigint", *(f"{k} bigint" for k in LANGUAGES)])
    counts = answers.unionByName(questions).mapInArrow(count, schema).groupBy("word").agg(*(F.sum(c).alias(c) for c in ("n", *LANGUAGES)))
    either = sum((F.col(k) for k in LANGUAGES), F.col("n"))
    found = counts.where(either >= max(3, min(COMMON_SHARES) * n)).collect()
    levels = [*((3, share) for share in COMMON_SHARES), (COMMON_FEW, max(COMMON_SHARES))]
    common = tuple(dict.fromkeys(frozenset(r["word"] for r in found if r["n"] >= max(few, share * n)) for few, share in levels))
    return common, {r["word"]: [r[k] for k in LANGUAGES] for r in found if any(r[k] for k in LANGUAGES)}


def _endings(answers: DataFrame, common: tuple[frozenset[str], ...], asked) -> DataFrame:
    """(kind, key, n): list items that others follow, short answers, and beginnings of answers, over distinct answers.

    Beginnings are counted only if they pass ``asked``, a Bloom filter of those that are asked for.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter[tuple[str, int]] = Counter()
            starts: list[int] = []
            for text in batch.column("text").to_pylist():
                text = text.strip()
                if not text:
                    continue
                for line in text.split("\n")[:-1]:
                    if m := _item.match(line):
                        seen["item", xxhash.xxh3_64_intdigest(m.group(1).strip().lower()) - (1 << 63)] += 1
                how, decides = ending(text)
                m = _sentence_ends.search(text)
                first = text[: m.start()] if m else text.split("\n")[0]
                for level, known in enumerate(common):
                    keys = chain(level, skeleton(first, known))
                    starts += keys[:-1]
                    if how == "phrase":
                        seen["phrase", keys[-1]] += 1
            keys = np.array(starts, np.int64)
            keys, n = np.unique(keys[passes(asked.value, keys)], return_counts=True)
            columns = ([*(k for k, _ in seen), *["start"] * len(keys)], [*(x for _, x in seen), *keys.tolist()], [*seen.values(), *n.tolist()])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64()))], ["kind", "key", "n"])

    return answers.select("text").mapInArrow(count, "kind string, key bigint, n bigint").groupBy("kind", "key").agg(F.sum("n").alias("n"))


def defects(pairs: DataFrame) -> DataFrame:
    """Rows (tbl, id, defect) of the pairs with a bad answer, one for each record.

    pairs: (tbl, id, question, answer, instruction), as from sft_pairs and qa_pairs. Copies are told by compressing the
    answer with the question as the dictionary; refusals and languages by dictionaries; truncation by how the answer
    ends, in a model of all answers' ends: a list's last item is whole if it stands further up in other lists, a phrase
    if many of the other distinct answers that begin like it end with it, so no answer vouches for itself or its copies.
    Repeated deliveries count once; if their contents differ,
    the least defect holds. An answer that is null is empty; a null question has neither copies nor a language; records
    without id are left out; an empty table gives no rows; other columns are ignored.
    """
    stash = Stash(pairs.sparkSession)
    pairs = pairs.where("id is not null")
    answers = stash.put(_distinct(pairs, "answer"))
    common, tongues = common_words(answers, _distinct(pairs, "question"))

    def classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = LanguageModel(tongues)
        for batch in batches:
            rows = []
            for tbl, id_, question, answer, instruction in zip(*(batch.column(c).to_pylist() for c in ("tbl", "id", "question", "answer", "instruction"))):
                defect, how, decides = judge(question, answer, instruction, model)
                asks: list[tuple] = []
                if defect is None and how == "item":
                    asks = [("item", xxhash.xxh3_64_intdigest(decides) - (1 << 63), None, 1)]
                elif defect is None and how == "phrase":
                    shapes = [skeleton(decides, known) for known in common]
                    if shapes[0] and (len(shapes[0]) > 1 or shapes[0][0] not in "_#"):
                        votes = LONG_VOTES if len(shapes[0]) > LONG_PHRASE else PHRASE_VOTES
                        asks = [("phrase", keys[-1], keys[-2], votes) for keys in map(chain, range(len(shapes)), shapes)]
                if defect or asks:
                    rows += [(tbl, id_, defect, *ask) for ask in asks or [(None,) * 4]]
            names = ("tbl", "id", "defect", "kind", "key", "start", "votes")
            columns = list(zip(*rows)) or [[]] * len(names)
            types = [*[pa.string()] * 4, pa.int64(), pa.int64(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    judged = stash.put(pairs.select("tbl", "id", "question", "answer", "instruction").mapInArrow(classify, "tbl string, id string, defect string, kind string, key bigint, start bigint, votes int"))
    open_ = judged.where("kind is not null")
    keys = stash.put(open_.select("kind", "key", "start", "votes").distinct())
    starting = keys.where("start is not null").select(F.col("start").alias("key")).distinct()
    asked = pairs.sparkSession.sparkContext.broadcast(bloom(starting, starting.count()))
    ends = stash.put(_endings(answers, common, asked))
    items = ends.where("kind <> 'start'").select("kind", "key", F.col("n").alias("n_whole"))
    starts = ends.where("kind = 'start'").select(F.col("key").alias("start"), F.col("n").alias("n_start"))
    known = keys.join(items, ["kind", "key"], "left").join(starts, "start", "left")
    others, begun = (F.greatest(F.coalesce(c, F.lit(0)) - 1, F.lit(0)) for c in ("n_whole", "n_start"))  # without the judged one
    voted = (others >= F.col("votes")) & (others >= PHRASE_SHARE * begun)
    whole = F.when(F.col("kind") == "item", F.coalesce("n_whole", F.lit(0)) >= 1).otherwise(voted)
    good = open_.join(known.where(whole).select("kind", "key"), ["kind", "key"], "left_semi").select("tbl", "id")
    cut = open_.join(good, ["tbl", "id"], "left_anti").select("tbl", "id", F.lit("truncated").alias("defect"))
    return judged.where("defect is not null").select("tbl", "id", "defect").unionByName(cut).groupBy("tbl", "id").agg(F.min("defect").alias("defect"))
