"""Sentence boundaries by cascading tables of segmentation rules.

Each line of a text is a segment of its own. Within a line the places behind end marks, and behind a letter
before a blank between Thai letters, are candidates; what closes - quotes, brackets, tags, emoticons - goes to
the sentence before. Inside quotations and brackets there is no candidate. Every candidate is decided by rules
(break or not, pattern before, pattern after): the first rule whose patterns match decides. The tables cascade:
quotations, the common rules, the rules of the text's language, its abbreviations, and last the default break.

Rules read a view of the line in which the marks of quotations are replaced by two signs, so that "a quotation
that opens the sentence ends here" is a pattern like any other. `before` ends at the candidate and looks back as
far as it needs; `^` stands for the sentence's start. The language is the one the words and letters of a line
speak for; the one named counts where these say nothing.
"""

from __future__ import annotations

import re
import sys
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.runtime import table

# The abbreviations of each language without their final mark, by what may follow.
# title: a name follows; never: can't end a sentence; number: doesn't end one before a number or a letter that numbers;
# may: ends one only before a word that opens sentences; ends: ends one unless a small letter, comma or number follows.
ABBREVIATIONS = {
    "en": {
        "title": "dr|mr|mrs|ms|prof|st|capt|gen|gov|sen|rep|lt|sgt|hon|mt|sir",
        "never": r"e\.g|i\.e|cf|vs|approx|ca|resp|incl|viz",
        "number": "figs?|eqs?|secs?|chr|vol|pp?|pos|refs?|tabs?|ch|rm|bldg|rev|nos?",
        "may": "al|dept|eds?|max|min|est|ext|avg",
        "ends": "etc|inc|ltd|co|corp|jr|sr",
    },
    "de": {
        "title": "dr|prof|hr|fr|st|ing|dipl",
        "never": r"bzw|ca|z\.\s?b|d\.\s?h|v\.\s?a|u\.\s?a|o\.\s?ä|i\.\s?d\.\s?r|vgl|evtl|ggf|inkl|zzgl|sog|bspw|max|min|abzgl|einschl|exkl",
        "number": "nr|abb|chr|tab|kap|bd|art|abs|s|ziff",
        "may": "tel|mio|mrd|str|std|jh|geb",
        "ends": "usw|usf|etc",
    },
    "es": {
        "title": "dr|dra|sr|sra|srta|d|prof|lic|ing|uds?",
        "never": r"p\.\s?ej|ej|aprox|máx|mín|cf",
        "number": "fig|págs?|núm|art|cap|vol|tel|tomo",
        "may": "ed|avda|ee\\.\\s?uu",
        "ends": "etc",
    },
    "fr": {
        "title": "mm?|dr|pr|me|st",
        "never": r"cf|env|p\.\s?ex|ex|c\.-à-d|max|min|av|apr",
        "number": "fig|pp?|art|chap|vol|n|tél",
        "may": "éd|boul|bd",
        "ends": "etc",
    },
    "ru": {
        "title": "проф|акад|др|им|г-н|г-жа",
        "never": r"см|напр|т\.\s?е|т\.\s?к|ср|т\.\s?н",
        "number": "рис|табл|стр|с|т|гл|ул|д|п|пп|изд",
        "may": r"тыс|млн|млрд|гг?|вв?|ред|обл|руб|коп|н\.\s?э|мин|сек",
        "ends": r"и\s+т\.\s?[дп]|и\s+др|и\s+пр",
    },
    "el": {"title": "κ|κα|κος|δρ|καθ", "never": r"π\.χ|βλ|δηλ", "number": "σελ|κεφ|αρ|εικ|πίν|τ", "may": r"μ\.μ|π\.μ|μ\.χ|π\.χ", "ends": r"κ\.?\s?λ\.?\s?π|κτλ|κλπ"},
    "ar": {"title": "د|أ|م", "never": "", "number": "ص|ج", "may": "", "ends": ""},
    "hi": {"title": "डॉ|श्री|प्रो|सुश्री|श्रीमती", "never": "", "number": "पृ|सं|क्र|रु", "may": "", "ends": ""},
    "th": {"title": "ดร|ศ|รศ|ผศ|นพ", "never": "", "number": "น|พ\\.ศ|ค\\.ศ", "may": r"ม\.ค|ก\.พ|มี\.ค|เม\.ย|พ\.ค|มิ\.ย|ก\.ค|ส\.ค|ก\.ย|ต\.ค|พ\.ย|ธ\.ค", "ends": ""},
    "it": {"title": "sig|sigg|dott|prof|avv|ing|arch|on|mons", "never": r"p\.\s?es|ad\s?es|cfr|ca|v", "number": "fig|pagg?|nn?|art|cap|vol|tel", "may": "ed", "ends": "ecc"},
    "pt": {"title": "sr|sra|dr|dra|prof|eng|exmo", "never": r"p\.\s?ex|aprox|cf", "number": "fig|págs?|núm|art|cap|vol|tel", "may": "ed|av", "ends": "etc"},
    "nl": {"title": "dhr|mevr|mw|dr|prof|ir|drs", "never": r"bijv|d\.w\.z|m\.a\.w|o\.a|ca|resp|evt|incl|excl|vgl|t\.o\.v", "number": "nr|blz|fig|hfst|art|tel", "may": "jl", "ends": "enz|etc"},
    "pl": {"title": "dr|prof|mgr|inż|hab|ks|św", "never": r"np|tzn|tj|tzw|m\.in|ok|por|wg", "number": "ul|nr|str|rys|tab|art|rozdz|s|t|godz|tel", "may": "r|w|tys", "ends": "itd|itp"},
    "ja": {},
    "zh": {},
}

# Words that open sentences and occur in every text of a language; they also tell the language.
OPENERS = {
    "en": "the a an it this that these those we i he she they you there then if when but and so in on at for with my our your what why how who is are was no yes not please only one each",
    "de": "der die das ein eine es wir ich er sie ihr und aber wenn dann im in am auf für mit mein unser was warum wie wer ist sind war nicht nein ja bitte dies diese dieser den dem zu von",
    "es": "el la los las un una es yo nosotros él ella ellos y pero si cuando entonces en para con mi nuestro qué por cómo quién no sí este esta esto hay de que del lo se",
    "fr": "le la les un une il elle nous je ils vous et mais si quand alors en dans pour avec mon notre que pourquoi comment qui est sont non oui ce cette ces on l d c de du des à au y a",
    "it": "il lo la i gli le un una è io noi lui lei loro e ma se quando allora in per con mio nostro che perché come chi non sì questo questa di del della al",
    "pt": "o a os as um uma é eu nós ele ela eles e mas se quando então em para com meu nosso que por como quem não sim este esta isto há de do da ao",
    "nl": "de het een wij we ik hij zij ze en maar als dan in op voor met mijn onze wat waarom hoe wie is zijn was niet nee ja dit dat deze die van te er",
    "pl": "to ten ta my ja on ona oni i a ale jeśli gdy wtedy w na dla z mój nasz co dlaczego jak kto jest są był nie tak ta tego się do że",
    "ru": "в и но а это этот эта мы я он она они вы если когда тогда на по для с у что почему как кто не да нет так мой наш все к о из от за при там",
    "el": "ο η το οι τα ένας μια είναι εγώ εμείς αυτός αυτή και αλλά αν όταν τότε σε για με μου μας τι γιατί πώς ποιος δεν ναι όχι στο στη την τον",
}

# Words that lose a vowel before an apostrophe.
ELISIONS = {"fr": "l d c j qu n s", "it": "l d c un"}

# Verbs that report speech.
SPEECH = {
    "en": "said says asked asks cried cries told tells wrote writes replied replies answered answers shouted yelled whispered murmured muttered mumbled grumbled added noted remarked exclaimed screamed called insisted explained admitted agreed argued sighed laughed joked warned complained suggested wondered thought claimed announced declared repeated began continued went snapped groaned moaned snarled hissed growled barked shrieked bellowed roared pleaded begged demanded objected protested interrupted observed commented concluded confirmed stated recalled",
    "de": "sagte fragte schrieb rief meinte antwortete erwiderte flüsterte murmelte erklärte",
    "es": "dijo preguntó escribió gritó respondió contestó añadió exclamó susurró murmuró",
    "fr": "dit demanda répondit écrivit cria ajouta murmura chuchota expliqua",
}
JOINERS = "and|or|but|und|oder|y|o|et|ou|и|а|но|και|e|en|i"
MONTHS = "Januar|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember"

EMOTICON = r"(?:[:;=][-']?[)(|]|[:;=]-[/\\\]\[]|[:=][/\\](?!/)|[:;=][-']?[DPp](?![\p{L}\p{N}])|\^\^|\(\^_\^\)|<3|[\p{Emoji_Presentation}\p{So}\p{Emoji_Modifier}‍️♀♂]+)"
CLOSING_TAG = r"(?:</[A-Za-z][^<>\n]*>|\[/[A-Za-z]+\]|&lt;/[A-Za-z]+&gt;|<br\s?/?>|&lt;br\s?/?&gt;)"
OPENING_TAG = r"(?:<[A-Za-z][^<>]*>|\[[A-Za-z][^\[\]]*\]|&lt;[A-Za-z]+&gt;)"
ENTITY = r"&(?:#\d+|#x[0-9a-fA-F]+|[A-Za-z]+);"
#: The view's signs of a quotation's opening and closing mark, and of the rest of a mark of several letters.
OPEN, SHUT, FILL = "", "", ""
CLOSERS = rf"(?:\s|{EMOTICON}|{CLOSING_TAG}|[\"'”’»“«‘」』）)\]】›{FILL}])*"
#: The end of a quotation that opens the sentence, and of any, with what closes behind it.
LEADING = rf"^(?:{OPENING_TAG}|\d{{1,3}}[.)](?=\s)|[\s(（\[【—–>•*-])*{OPEN}[^{OPEN}{SHUT}]*{SHUT}{CLOSERS}$"
ENDING = rf"{SHUT}{CLOSERS}$"
CAPITAL = r"\s*[^\p{L}\p{N}]*\p{Lu}"
GLUED = rf"(?:{OPENING_TAG}|[\"'“„«¿¡(\[{OPEN}{FILL}])*\p{{Lu}}"
#: What may stand before the first word of a sentence.
LEAD_IN = r"(?:\W|\d{1,3}[.)]\s|<\w+>|\[\w+(?:=\w+)?\]|&lt;\w+&gt;)*"
#: Before a word: the line's start, or something that is no part of a word.
START = r"(?<![^\s\p{P}\p{S}-])"
WIDE = "。！？｡।॥။።"


class Rule(NamedTuple):
    """Whether to break where `before` ends and `after` begins.

    marks: the end marks it is for, all when empty. tail: `before` runs through all that closes, else up to the end mark
    and closing quotes and brackets. spaced: for candidates with (True) or without (False) a blank behind, None for both.
    ends: for an index, the words that `before` can have before its full stop, `?` for any single letter, `#` for a
    digit; None for all.
    """

    keep: bool
    before: str
    after: str
    marks: str = ""
    tail: bool = False
    spaced: bool | None = None
    ends: frozenset[str] | None = None


def _ends(text: str) -> frozenset[str]:
    return frozenset(text.split())


def _stems(pattern: str) -> frozenset[str]:
    """The last letters of each abbreviation of a table's pattern, in small letters."""
    found = set()
    for one in pattern.split("|"):
        for form in (one.replace("?", ""), re.sub(r".\?", "", one.replace(r"\.?", r"\.").replace(r"\s?", " ")), one.replace(r"\s?", " ").replace(r"\s+", " ").replace("?", "")):
            if group := re.search(r"\[([^\]]+)\]$", form):
                found |= set(group.group(1))
            elif tail := re.search(r"[^\W\d_]+$", form):
                found.add(tail.group())
    return frozenset(found)


def _words(text: str) -> str:
    return "|".join(text.split())


REPORTS = "|".join(_words(v) for v in SPEECH.values())

#: Quotations: a quotation and the clause that reports it are one sentence.
QUOTATIONS = [
    Rule(False, ENDING, "(?:と|って)", tail=True),
    Rule(False, LEADING, rf"(?!{CAPITAL})", tail=True),
    Rule(False, LEADING, rf"[\s,]*(?:\p{{L}}\S*\s+){{1,2}}(?:{REPORTS})\b", tail=True),
    # a name and what it did, to the end of a short clause: "Tom yelled."
    Rule(False, LEADING, rf"\s+(?!(?i:{_words(OPENERS['en'])})\b)\p{{Lu}}\p{{Ll}}+\s+\p{{Ll}}+ed(?:\s+\p{{Ll}}+){{0,2}}[.!?](?=\s|$)", tail=True),
    Rule(True, LEADING, rf"\s|{GLUED}", tail=True),
    Rule(True, rf"{SHUT}{CLOSERS}(?:{EMOTICON}|{CLOSING_TAG})\s*$", "", tail=True),
    Rule(False, LEADING, "", tail=True),
    Rule(False, ENDING, rf"\s*(?:[,，、;:]|&amp;|&(?=\s)|(?:{JOINERS}|{_words(SPEECH['en'])})\b)", tail=True),
    Rule(True, ENDING, "", tail=True),
]

#: Marks that aren't followed by a blank.
UNSPACED = [
    Rule(True, rf"(?:{EMOTICON}|{CLOSING_TAG})\s*$", "", tail=True, spaced=False),
    Rule(True, r"[!?]+[^\p{L}\p{N}\s]*$", r"[⺀-\U0003ffff]", "!?", spaced=False),
    Rule(False, "", rf"(?!{GLUED})", spaced=False),
    Rule(False, r"(?<![\p{Ll}\p{Lo}]{2}|\d)[.!?…]+$", "", spaced=False),
    Rule(True, r"\.{3,}$", "", ".", spaced=False),
]

#: Rules for all languages.
COMMON = [
    Rule(True, rf"[{WIDE}]+[^\p{{L}}\p{{N}}]*$", "(?![,，、])", WIDE, tail=True),
    Rule(False, rf"[{WIDE}]+[^\p{{L}}\p{{N}}]*$", "", WIDE, tail=True),
    Rule(False, rf"{SHUT}\s*[!?]+$", rf"\s+(?:{REPORTS})\b", "!?"),  # the mark behind the quotation
    *UNSPACED,
    Rule(False, r"^\W*\d{1,3}[.)]$", r"\s*\S", ".", ends=_ends("#")),  # a list number
    Rule(False, r"[!?…]\s*[\"'”’»«“)\]]*$", r"\s*[—–-]+\s*\p{Ll}", "!?…"),  # a reporting clause behind a dash
]

#: An ellipsis goes on in the same sentence before a small letter. In texts that open sentences with small letters
#: it does so only behind an opening of two words at most.
PAUSE = [
    Rule(False, rf"^{LEAD_IN}\w[\w'’]*(?:\s+\w[\w'’]*)?\W*(?:\.{{2,}}|…)$", r"\s+(?:\[\w+(?:=\w+)?\]|<\w+>|&lt;\w+&gt;)*[^\s\p{Lu}\[<&]*\p{Ll}", ".…"),
]
PAUSE_CASED = [Rule(False, r"(?:\.{2,}|…)$", r"\s+(?:\[\w+(?:=\w+)?\]|<\w+>|&lt;\w+&gt;)*[^\s\p{Lu}\[<&]*\p{Ll}", ".…")]

#: Letters with marks: initials and the like. {opener} is a capitalised word that opens sentences.
LETTERS = [
    Rule(True, START + r"(?:\p{L}\.){2,}$", r"\s+(?:{opener})\b(?![.'’])", ".", ends=_ends("?")),
    Rule(True, START + r"\p{Lu}\.$", r"\s+(?:{opener})\b(?![.'’])", ".", ends=_ends("?")),
    Rule(False, START + r"(?:\p{L}\.\s?)*\p{Lu}\.$", r"\s+(?:\p{L}\.|\p{L}{2,}|\p{Lu})", ".", ends=_ends("?")),
    Rule(False, START + r"(?:\p{L}\.){2,}$", r"\s+\p{Ll}", ".", ends=_ends("?")),
]

#: Abbreviations that number something do so in texts of any language, before a number.
NUMBERED = [Rule(False, rf"{START}(?:{'|'.join(v['number'] for v in ABBREVIATIONS.values() if v.get('number'))})\.$", r"\s*\d", ".", ends=_stems("|".join(v["number"] for v in ABBREVIATIONS.values() if v.get("number"))))]

#: What a language has besides its abbreviations; tried before them.
SPECIAL = {
    "en": [
        # a phrase of time that opens the sentence
        Rule(False, rf"^{LEAD_IN}(?:at|by|until|before|after|around|from|since|till)\s+(?:\S+\s+){{0,2}}\d+(?:[:.]\d+)?\s*(?:\S+\s+)?[ap]\.m\.$", "", ".", ends=_ends("m")),
        Rule(False, r"\d\s?[ap]\.m\.$", r"\s+(?:on|in|and|or|to|but|every|each)\b", ".", ends=_ends("m")),
        Rule(True, r"\d\s?[ap]\.m\.$", r"\s", ".", ends=_ends("m")),
        Rule(True, START + r"etc\.$", r"\s", ".", ends=_ends("etc")),
        Rule(False, START + r"nos?\.$", r"\s*(?:[^\sA-Za-z<\[&\"'“«„(]\S*\s+)?\d", ".", ends=_ends("no nos")),  # also words
        Rule(True, START + r"nos?\.$", "", ".", ends=_ends("no nos")),
    ],
    "de": [
        Rule(False, r"\b(?:am|im|der|den|dem|des|vom|zum|beim|bis|seit|ab|das|die|jeden|jedes|jeder)\s(?:\S+\s)?\d{1,2}\.$", r"\s+\p{L}", ".", ends=_ends("#")),
        Rule(False, r"\b\d{1,2}\.$", rf"\s+(?:{MONTHS})\b", ".", ends=_ends("#")),
        Rule(True, START + r"us[wf]\.$", r"\s", ".", ends=_ends("usw usf")),
        Rule(False, START + r"(?:z|d|v|u|o|i|s|a)\.$", r"\s?(?:B|h|a|ä|d|R|o)\.(?!\p{L})", ".", ends=_ends("z d v u o i s a")),
    ],
    "es": [Rule(True, START + r"etc\.$", r"\s", ".", ends=_ends("etc"))],
    "fr": [Rule(True, START + r"etc\.$", r"\s", ".", ends=_ends("etc"))],
    "ru": [Rule(True, START + r"и\s+(?:т\.\s?[дп]|др|пр)\.$", r"\s", ".", ends=_ends("д п др пр")), Rule(False, START + r"т\.$", r"\s*[едкнп]\.", ".", ends=_ends("т")), Rule(False, START + r"н\.$", r"\s*э\.", ".", ends=_ends("н"))],
    "el": [Rule(True, START + r"κ\.?\s?λ\.?\s?π\.$", r"\s", ".", ends=_ends("π")), Rule(False, START + r"κ\.\s?λ\.$", r"\s*π\.", ".", ends=_ends("λ"))],
}


def abbreviation_rules(lang: str) -> list[Rule]:
    """A language's abbreviations as rules."""
    kinds = ABBREVIATIONS.get(lang) or {}
    made = []

    def add(kind: str, keep: bool, after: str) -> None:
        if kinds.get(kind):
            made.append(Rule(keep, rf"{START}(?:{kinds[kind]})\.$", after, ".", ends=_stems(kinds[kind])))

    # within an abbreviation of several parts
    for one in "|".join(filter(None, kinds.values())).split("|"):
        parts = one.split(r"\.\s?")
        for i in range(1, len(parts)):
            made.append(Rule(False, START + r"\.\s?".join(parts[:i]) + r"\.$", r"\s?" + r"\.\s?".join(parts[i:]) + r"\.", ".", ends=_stems(r"\.\s?".join(parts[:i]))))

    add("title", False, r"\s*\S")
    add("never", False, r"\s*\S")
    add("number", False, r"\s*[\p{N}\[(#§]|\s*(?:\p{L}|[IVXLC]+)(?![\p{L}\p{N}.])|\s*\p{L}{0,3}\d|\s*\p{Ll}")
    add("number", True, r"\s+(?:{opener})\b(?![.'’])")
    add("number", False, r"\s*\S")
    add("may", True, r"\s+(?:{opener})\b(?![.'’])")
    add("may", False, r"\s*\S")
    add("ends", False, r"\s*(?:[,;:)\p{N}]|\p{Ll})")
    return made


#: The last rules of the cascade.
DEFAULT = [Rule(True, "", "")]


def rules_for(lang: str, cased: bool) -> list[Rule]:
    """The whole cascade for a language; `cased`: the text opens its sentences with capital letters."""
    return [*QUOTATIONS, *COMMON, *PAUSE, *(PAUSE_CASED if cased else []), *SPECIAL.get(lang, []), *NUMBERED, *abbreviation_rules(lang), *LETTERS, *DEFAULT]


PAIRS = {"“": "”", "„": "“”", "«": "»", "»": "«", "「": "」", "『": "』", "‹": "›", "‚": "‘’", "‘": "’"}
QUOTES = {'"', "&quot;", "'", "“", "«", "‘", "»", "”", "’", "」", "』", "›"}
BRACKETS = {"(": ")", "（": "）", "[": "]", "【": "】"}
#: Scripts that tell the language, first match first.
SCRIPTS = {"ja": r"[\p{Hiragana}\p{Katakana}]", "zh": r"\p{Han}", "th": r"\p{Thai}", "hi": r"\p{Devanagari}", "ar": r"\p{Arabic}", "el": r"\p{Greek}", "ru": r"\p{Cyrillic}"}


@dataclass
class Text:
    """What the lines of a text share: the language named, whether its sentences open with capitals, the language spoken."""

    whole: str
    named: str
    cased: bool | None = None
    lang: str | None = None
    line: str | None = None
    spoken: str = ""


def stems() -> set[str]:
    """All words that rules have before a full stop."""
    every = [r for lang in ABBREVIATIONS for r in rules_for(lang, True)]
    return {w for r in every for w in r.ends or () if w not in "?#"}


class Splitter:
    """The compiled tables."""

    def __init__(self):
        import regex

        self.regex = regex
        c = lambda p, f=0: regex.compile(p, f | regex.VERSION0)
        self.lines = c(r"[^\r\n\x0b\x0c\x85  ]+")
        self.prefix = c(r"(?:[\s﻿]|>|[•*‣◦▪●○·–-](?=\s))*")
        self.word = c(r"[\p{L}\p{N}]")
        self.marks = c(r"[.…;\p{Sentence_Break=STerm}]+|;+(?!-?[)(])")
        self.close = c(rf"(?:\s*(?:{EMOTICON})|\s*{CLOSING_TAG}|&quot;|[\"'”’»“«‘」』）)\]】›])")
        self.thai = c(rf"(?<=[฀-๿])(?:\s*(?:{EMOTICON}|{CLOSING_TAG}))*(?=\s+[฀-๿])")
        self.entity = c(ENTITY)
        self.greek = c(r"\p{Greek}")
        self.quote = c(r"&quot;|[\"“”„«»「」『』‹›‘’']")
        self.single = c(r"[,.!?…]'(?!\w)")
        self.bracket = c(r"[()（）\[\]【】]")
        self.thai_letter = c(r"[฀-๿]")
        self.address = c(r"[A-Za-z][A-Za-z0-9+.-]*://[!-~]+")
        self.small_start = c(r"(?:(?:^|\n)[\s>]*|[\p{Ll}\d][.!?]\s+)\p{Ll}{2}")
        self.letters = c(r"(\p{L}+)([.'’]?)")
        self.markup = c(rf"<[^<>]*>|\[/?[A-Za-z][^\[\]]*\]|&lt;/?[A-Za-z]+&gt;|{ENTITY}")
        self.any_script = c("|".join(SCRIPTS.values()))
        self.scripts = {k: c(v) for k, v in SCRIPTS.items()}
        self.openers: dict[str, list[str]] = {}
        for lang, words in OPENERS.items():
            for w in words.split():
                if len(w) > 1:
                    self.openers.setdefault(w, []).append(lang)
        self.elided: dict[str, list[str]] = {}
        for lang, words in ELISIONS.items():
            for w in words.split():
                self.elided.setdefault(w, []).append(lang)
        self.stems = stems()
        self.longest = max(map(len, self.stems))
        # an abbreviation of few languages speaks for them
        self.short: dict[str, list[str]] = {}
        for lang, kinds in ABBREVIATIONS.items():
            for w in {w for v in kinds.values() for w in v.split("|") if len(w) > 1 and w.isalpha()}:
                self.short.setdefault(w, []).append(lang)
        self.tables: dict[tuple, list] = {}
        self.compiled: dict[tuple, object] = {}

    # ---- the tables --------------------------------------------------------------------------------

    def pattern(self, text: str, back: bool):
        """A compiled pattern; one of `before` is matched backwards from its end."""
        key = text, back
        if key not in self.compiled:
            bare = text.removeprefix("^").removesuffix("$") if back else text
            self.compiled[key] = self.regex.compile(bare, self.regex.VERSION0 | (self.regex.REVERSE if back else 0)) if bare else None
        return self.compiled[key]

    def cascade(self, lang: str, cased: bool, mark: str, spaced: bool, closed: bool, word: str | None) -> list:
        """The rules that can match such a candidate, in their order, compiled."""
        key = lang, cased, mark, spaced, closed, word
        if key not in self.tables:
            opener = "|".join(w.capitalize() for w in OPENERS.get(lang, OPENERS["en"]).split())
            loose = {id(r) for r in [*SPECIAL.get(lang, [])]}
            made = []
            for r in rules_for(lang, cased):
                if r.marks and mark not in r.marks or r.spaced not in (None, spaced) or r in QUOTATIONS and not closed:
                    continue
                if word is not None and r.ends is not None and word not in r.ends and not (len(word) == 1 and word != "#" and "?" in r.ends):
                    continue
                # abbreviations and the language's own rules hold in either case
                any_case = "(?i)" if r.before.startswith(START) and r not in LETTERS or id(r) in loose else ""
                after = r.after.replace("{opener}", opener)
                made.append((r.keep, self.pattern(any_case + r.before.removeprefix("^"), True) if r.before else None, self.pattern(after, False) if after else None, r.before.startswith("^"), r.tail))
            self.tables[key] = made
        return self.tables[key]

    # ---- the text and its lines ----------------------------------------------------------------------

    def script(self, text: str) -> str | None:
        if not self.any_script.search(text):
            return None
        return next(lang for lang, p in self.scripts.items() if p.search(text))

    def spoken(self, line: str, hint: str | None) -> str | None:
        """The language of a line by its letters and its most frequent words; the hint where they say little. Without hint, None there."""
        if not line.isascii() and (own := self.script(line)):
            return own
        votes: dict[str, float] = {hint: 0.5} if hint in OPENERS else {}
        for w, mark in self.letters.findall(self.markup.sub(" ", line.lower())):
            for lang in self.openers.get(w, ()):
                votes[lang] = votes.get(lang, 0) + 1
            if mark:
                told = (self.short if mark == "." else self.elided).get(w, ())
                for lang in told:
                    votes[lang] = votes.get(lang, 0) + 2 / len(told)
        if hint is None:
            best = sorted(votes.values())[-2:]
            return max(votes, key=votes.get) if len(best) == 1 or len(best) == 2 and best[1] - best[0] > 0.5 else None
        return max(votes, key=votes.get) if votes else hint if hint in ABBREVIATIONS else "en"

    def quotations(self, line: str) -> list[tuple[int, int, int, int]]:
        """(start and end of the opening mark, start and end of the closing mark) of each quotation, in order; one that isn't closed goes on to the line's end."""
        found, open_ = [], None
        last_single = max((m.start() for m in self.single.finditer(line)), default=-1) if "'" in line else -1
        last_curly, last_guillemet = line.rfind("’"), line.rfind("«")
        for m in self.quote.finditer(line):
            q, at, end = m.group(), m.start(), m.end()
            if open_ is not None:
                kind, start, stop = open_
                closes = kind == q and q in ('"', "&quot;") or q in PAIRS.get(kind, "") or kind == q == "'" and line[at - 1] in ",.!?…" and not line[end : end + 1].isalnum()
                if closes:
                    found.append((start, stop, at, end))
                    open_ = None
            elif q == "'":
                # an apostrophe opens a quotation only if it can be closed
                before, after = line[at - 1 : at], line[end : end + 1]
                if (not before or before.isspace() or before in "([{>;]\"—-.!?。！？") and after.isalpha() and last_single >= end:
                    open_ = (q, at, end)
            elif q == "‘":
                if last_curly >= end:
                    open_ = (q, at, end)
            elif q in PAIRS and not (q == "»" and last_guillemet < end) or q in ('"', "&quot;"):
                open_ = (q, at, end)
        if open_ is not None and open_[0] not in ("'", "‘", "»"):
            found.append((open_[1], open_[2], len(line) + 1, len(line) + 1))
        return found

    def brackets(self, line: str) -> list[tuple[int, int]]:
        """The outermost bracketed stretches, in order."""
        found, stack = [], []
        for m in self.bracket.finditer(line):
            i, ch = m.start(), m.group()
            if ch in BRACKETS:
                if line[i - 1 : i] not in (":", ";", "-", "="):
                    stack.append((BRACKETS[ch], i))
            elif stack and ch == stack[-1][0]:
                a = stack.pop()[1]
                while found and found[-1][0] > a:
                    found.pop()
                found.append((a, i + 1))
        return found

    def view(self, line: str, quotes: list[tuple[int, int, int, int]]) -> str:
        """The line as rules read it, as long as itself: the marks of quotations are signs."""
        if not quotes:
            return line
        out, done = [], 0
        for a, b, c, d in quotes:
            out += [line[done:a], OPEN, FILL * (b - a - 1), line[b:c]]
            if c <= len(line):
                out += [FILL * (d - c - 1), SHUT]
            done = d
        return "".join([*out, line[done:]])

    def cased(self, text: Text) -> bool:
        if text.cased is None:
            text.cased = self.small_start.search(text.whole) is None
        return text.cased

    def spoken_once(self, line: str, text: Text) -> str:
        """spoken() of a line, asked once for it."""
        if text.line is not line:
            lang = self.spoken(line, None)
            if lang is None:  # the whole text tells
                if text.lang is None:
                    text.lang = self.spoken(text.whole, text.named)
                lang = self.spoken(line, text.lang)
            text.line, text.spoken = line, lang
        return text.spoken

    def last_word(self, view: str, begin: int, at: int, stop: int, q: int) -> str | None:
        """Of a candidate that isn't behind a quotation and before a blank, what rules it can meet: empty for the default only,
        the word of an abbreviation before a full stop, `?` for another single letter, `#` for a digit, None for any.
        An index to the tables, which decide alike without it."""
        mark, last = view[at], view[at - 1] if at > begin else " "
        if mark == ".":
            if stop - at > 1 or last == "." or not last.isascii() and last >= "\u0530":
                return None
            if last.isdigit():  # an ordinal or a list number has three digits at most, and is no part of a longer number
                k = at - 1
                while k > begin and at - k < 4 and view[k - 1].isdigit():
                    k -= 1
                return "" if at - k > 3 or k > begin and view[k - 1] in ".,:/-–v" else "#"
            if not last.isalpha():
                return "" if last > " " else None
            k = at - 1
            while k > begin and at - k <= self.longest and view[k - 1].isalpha():
                k -= 1
            word = view[k:at].lower()
            return word if word in self.stems else "?" if len(word) == 1 else ""
        if mark not in "!?":
            return None
        return "" if last != SHUT and view[q : q + 8].lstrip()[:1] not in ("—", "–", "-", "") else None


    def line(self, line: str, text: Text) -> Iterator[tuple[int, int]]:
        start = self.prefix.match(line).end()
        end = len(line)
        while end > start and (line[end - 1].isspace() or line[end - 1] == "﻿"):
            end -= 1
        if not self.word.search(line, start, end):
            return
        places = self.candidates(line, start, end)
        if not places:
            yield from self.spans(line, start, end, [])
            return
        quotes = self.quotations(line)
        brackets = self.brackets(line)
        view = self.view(line, quotes)
        opens, closes = {q[0] for q in quotes}, {q[3]: q for q in quotes}
        starts, bracket_starts = [q[0] for q in quotes], [a for a, _ in brackets]
        cuts, done = [], start
        for at, stop, blank in places:
            if at < done:
                continue
            q, closed, bare = stop, False, True
            if not blank:
                q, closed, bare = self.closing(line, stop, end, opens, closes)
                k = bisect_left(starts, at) - 1
                # a closing mark may stand behind a blank
                if k >= 0 and q < quotes[k][3] <= end and line[q : quotes[k][3]].strip() in ("»", "«", "”", "“"):
                    closed = True
                    q, _, more = self.closing(line, quotes[k][3], end, opens, {})
                    bare = bare and more
            if q >= end:
                break
            k, b = bisect_left(starts, at) - 1, bisect_left(bracket_starts, at) - 1
            if k >= 0 and quotes[k][3] > q or b >= 0 and brackets[b][1] > q:
                continue
            if not blank:
                word = None if closed or not view[q].isspace() else self.last_word(view, done, at, stop, q)
                if word == "":
                    blank = True  # only the default can match
                else:
                    own = self.spoken_once(line, text) if line[at] == "." else ""
                    # only an ellipsis asks whether the text opens its sentences with capitals
                    cased = line[at] not in ".…" or stop - at == 1 and line[at] == "." or self.cased(text)
                    blank = self.ruled(view, done, stop if not bare else q, q, end, own, cased, line[at], closed, word)
            if blank:
                cuts.append(q)
                done = q
        yield from self.spans(line, start, end, cuts)

    def candidates(self, line: str, start: int, end: int) -> list[tuple[int, int, bool]]:
        """(start, end, whether it is a blank between Thai letters) of each place that may end a sentence."""
        places = []
        entities = addresses = greek = None
        for m in self.marks.finditer(line, start, end):
            at, stop, mark = m.start(), m.end(), m.group()
            # before a small letter or digit no rule lets a full stop end anything
            if mark == "." and stop < end and ("a" <= line[stop] <= "z" or "0" <= line[stop] <= "9"):
                continue
            # a semicolon asks in Greek only, and doesn't when it ends an entity
            if mark[0] == ";":
                greek = bool(self.greek.search(line)) if greek is None else greek
                entities = {e.end() - 1 for e in self.entity.finditer(line)} if entities is None else entities
                if not greek or stop - 1 in entities:
                    continue
            if mark[0] not in ".;" and "://" in line:
                if addresses is None:
                    addresses = [(a.start(), a.start() + len(a.group().rstrip(".,!?;:)]}\"'>"))) for a in self.address.finditer(line)]
                if any(a < at < b for a, b in addresses):
                    continue
            places.append((at, stop, False))
        if not line.isascii() and self.thai_letter.search(line):
            places += [(m.start(), m.end(), True) for m in self.thai.finditer(line, start, end)]
            places.sort()
        return places

    def closing(self, line: str, q: int, end: int, opens: set[int], closes: dict) -> tuple[int, bool, bool]:
        """What closes behind an end mark: where it ends, whether a quotation ends in it, and whether no tag or emoticon is in it."""
        closed, bare = False, True
        while q < end:
            m = self.close.match(line, q, end)
            if not m or m.end() == q:
                break
            piece = m.group().lstrip()
            if piece in QUOTES:
                # a mark that opens the next quotation belongs to that
                if m.end() - len(piece) in opens or piece == "'" and m.end() not in closes and line[m.end() : m.end() + 1].isalnum():
                    break
                closed = closed or m.end() in closes
            elif piece.strip() and piece not in ")）]】":
                bare = False
            q = m.end()
        return q, closed, bare

    def ruled(self, view: str, begin: int, stop: int, q: int, end: int, lang: str, cased: bool, mark: str, closed: bool, word: str | None) -> bool:
        """The decision of the first rule that matches: `before` ends at q (tail) or at stop, `after` starts at q."""
        for keep, before, after, whole, tail in self.cascade(lang, cased, mark, view[q].isspace(), closed, word):
            if after is not None and not after.match(view, q, end):
                continue
            if before is not None:
                to = q if tail else stop
                if not before.match(view, begin, to) or whole and not before.fullmatch(view[begin:to]):
                    continue
            return keep
        return True

    def spans(self, line: str, start: int, end: int, cuts: list[int]) -> list[tuple[int, int]]:
        """The trimmed parts between the cuts; a part without letter or digit joins the one before, or else the next."""
        out, lead = [], None
        for a, b in zip([start, *cuts], [*cuts, end], strict=True):
            while a < b and line[a].isspace():
                a += 1
            while b > a and line[b - 1].isspace():
                b -= 1
            if a == b:
                continue
            if not self.word.search(line, a, b):
                if out:
                    out[-1] = (out[-1][0], b)
                elif lead is None:
                    lead = a
                continue
            out.append((a if lead is None else lead, b))
            lead = None
        return out

    def split(self, text: str | None, lang: str | None = None) -> list[tuple[int, int]]:
        """(start, end) of each sentence in code points, end exclusive; none for a null, empty or blank text."""
        if not text:
            return []
        facts = Text(text, (lang or "").strip().lower()[:2])
        return [(m.start() + a, m.start() + b) for m in self.lines.finditer(text) for a, b in self.line(m.group(), facts)]


def splitter() -> Splitter:
    """The splitter of a Python worker, compiled once."""
    store = sys.__dict__.setdefault("_strandloom_splitter", [])
    if not store:
        store.append(Splitter())
    return store[0]


def sentences(df: DataFrame, doc_id: str, text: str, lang: str) -> DataFrame:
    """(doc_id, sent_start, sent_end): one row per sentence of each text, in code points, end exclusive.

    A null, empty or blank text has no sentence; any other letter or digit lies in exactly one. The
    language is a hint: an unknown, wrong or null one changes only which rules come first. Repeated rows
    give repeated sentences; other columns don't enter.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = splitter()
        for b in batches:
            ids, starts, ends = [], [], []
            for i, (t, g) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)):
                for x, y in s.split(t, g) if t else ():
                    ids.append(i)
                    starts.append(x)
                    ends.append(y)
            yield pa.record_batch([b.column(0).take(pa.array(ids, pa.int64())), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], ["_id", "sent_start", "sent_end"])

    kind = df.schema[doc_id].dataType.simpleString()
    return df.select(F.col(doc_id).alias("_id"), F.col(text).cast("string").alias("_text"), F.col(lang).cast("string").alias("_lang")).mapInArrow(run, f"_id {kind}, sent_start bigint, sent_end bigint").withColumnRenamed("_id", doc_id)


def found(spark, sf: str) -> DataFrame:
    """p9_found: the sentences of every document."""
    return sentences(table(spark, sf, "documents"), "doc_id", "text", "lang")


def lengths(spark, sf: str) -> DataFrame:
    """p9_lengths: per language as stored, the documents with sentences, the sentences and their code points."""
    docs = table(spark, sf, "documents").select("doc_id", F.lower(F.trim("lang")).alias("lang"))
    return found(spark, sf).join(docs, "doc_id").groupBy("lang").agg(F.count_distinct("doc_id").alias("documents"), F.count("*").alias("sentences"), F.sum(F.col("sent_end") - F.col("sent_start")).alias("code_points"))
