"""Defective question and answer pairs, each with its one defect.

What an answer shows by itself (nothing in it, broken off, a refusal, its language) is found once
an answer, before answers are joined to their questions; what takes both (a copy of the question)
is found on the joined pairs, and only where the answer has few words that the question lacks.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import cache, lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Words that stand where an answer should.
PLACEHOLDERS = {
    "none", "null", "nil", "nan", "na", "n a", "tbd", "tba", "tbc", "todo", "to do", "blank", "empty", "unknown", "missing", "pending", "placeholder", "answer", "response", "text",
    "no answer", "not available", "not applicable", "not provided", "no response", "no data", "no content", "to be added", "to be determined", "to be done", "to be confirmed",
    "to be written", "to follow", "coming soon", "work in progress", "insert answer here", "answer here", "add answer here", "your answer here",
}

# Common function words by language.
FUNCTION_WORDS = {
    "en": "the a an of and to in is it that for on with as are was by at from this be have not or but they we you i who what how should which has had do does will would can when before after only so their its our my first then",
    "fr": "le la les un une des du de et est que qui dans pour sur avec ce cette pas ne il elle nous vous je au aux par plus été avait sans mais ont leur ses notre doit faire si très être ou déjà oui non",
    "de": "der die das ein eine einen und ist von zu den dem mit für auf nicht sich im auch wie hat wurde bei aus nach sie wir ich es aber oder noch schon wenn sollte war als keine unsere einem weil damit vor ja nein",
    "es": "el la los las un una de y es que en por para con no se su al del lo como más pero sus ya le este esta qué si sin muy fue ha nuestro porque luego antes debería casi sí",
    "it": "il lo la gli i un una di e è che in per con non si del della dei ha come più ma sono alla nel già da al nostro perché dopo prima senza poi questo cosa dovrebbe sì no",
    "pt": "o a os as um uma de e é que em por para com não se do da dos no na mais mas como ao já foi sua seu nosso porque depois antes sem isso uma deve fazer toda sim",
    "nl": "de het een en van in is dat op te voor met niet aan er zijn die was ook als bij heeft om wij ik maar of naar door nog geen onze omdat wat moet zonder hebben bijna wordt over uit ja nee",
    "sv": "och att det som en ett på är av för med den till inte har de om var jag vi men från kan ska sig så när eller efter före över också mycket skulle ja nej",
    "da": "og at det som en et på er af for med den til ikke har de om var jeg vi men fra kan skal sig så når eller efter før over også meget skulle ja nej",
    "fi": "ja on ei se että hän ovat oli mutta kun niin joka myös kuin tai jos ole vain sekä ennen jälkeen kanssa ilman meidän mukaan joo",
    "pl": "i w nie na się z do że jest to jak o ale po co za od tak czy przez który która oraz już są był tylko przed dla może ich także",
    "cs": "a v se na je že to s z do o jako ale po by jsou který která byl také už nebo jen pro před bez když může podle aby ano ne",
    "ro": "și în nu pe că de la cu este un o din care pentru mai sunt dar după sau fără acest această fost între când trebuie da",
    "hu": "a az és hogy nem is egy ez van de volt meg már csak mint vagy még után előtt ha kell nélkül között azt lehet igen",
    "tr": "ve bir bu için da de ile ne o gibi daha çok ama olarak var kadar sonra önce mi ya değil olan her evet hayır",
}

# The first article of the Universal Declaration of Human Rights, by language.
ARTICLE = {
    "en": "All human beings are born free and equal in dignity and rights. They are endowed with reason and conscience and should act towards one another in a spirit of brotherhood.",
    "fr": "Tous les êtres humains naissent libres et égaux en dignité et en droits. Ils sont doués de raison et de conscience et doivent agir les uns envers les autres dans un esprit de fraternité.",
    "de": "Alle Menschen sind frei und gleich an Würde und Rechten geboren. Sie sind mit Vernunft und Gewissen begabt und sollen einander im Geist der Brüderlichkeit begegnen.",
    "es": "Todos los seres humanos nacen libres e iguales en dignidad y derechos y, dotados como están de razón y conciencia, deben comportarse fraternalmente los unos con los otros.",
    "it": "Tutti gli esseri umani nascono liberi ed eguali in dignità e diritti. Essi sono dotati di ragione e di coscienza e devono agire gli uni verso gli altri in spirito di fratellanza.",
    "pt": "Todos os seres humanos nascem livres e iguais em dignidade e em direitos. Dotados de razão e de consciência, devem agir uns para com os outros em espírito de fraternidade.",
    "nl": "Alle mensen worden vrij en gelijk in waardigheid en rechten geboren. Zij zijn begiftigd met verstand en geweten, en behoren zich jegens elkander in een geest van broederschap te gedragen.",
    "sv": "Alla människor är födda fria och lika i värde och rättigheter. De är utrustade med förnuft och samvete och bör handla gentemot varandra i en anda av broderskap.",
    "da": "Alle mennesker er født frie og lige i værdighed og rettigheder. De er udstyret med fornuft og samvittighed, og de bør handle mod hverandre i en broderskabets ånd.",
    "fi": "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä.",
    "pl": "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa.",
    "cs": "Všichni lidé rodí se svobodní a sobě rovní co do důstojnosti a práv. Jsou nadáni rozumem a svědomím a mají spolu jednat v duchu bratrství.",
    "ro": "Toate ființele umane se nasc libere și egale în demnitate și în drepturi. Ele sunt înzestrate cu rațiune și conștiință și trebuie să se comporte unele față de altele în spiritul fraternității.",
    "hu": "Minden emberi lény szabadon születik és egyenlő méltósága és joga van. Az emberek, ésszel és lelkiismerettel bírván, egymással szemben testvéri szellemben kell hogy viseltessenek.",
    "tr": "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler ve birbirlerine karşı kardeşlik zihniyeti ile hareket etmelidirler.",
}
_SPEAKS = {w: frozenset(lang for lang, ws in FUNCTION_WORDS.items() if w in ws.split()) for ws in FUNCTION_WORDS.values() for w in ws.split()}

#: How much less likely (natural logarithm) a text has to be in a language than in the likeliest
#: one to rule it out, in all and a letter, where function words do not decide.
MARGIN, MARGIN_LETTER = 4.0, 0.3

# Scripts that tell the language (or family) by themselves.
SCRIPTS = {"ja": "[぀-ヿ]", "zh": "[一-鿿]", "ko": "[가-힯]", "ru": "[Ѐ-ӿ]", "ar": "[؀-ۿ]", "el": "[Ͱ-Ͽ]", "he": "[֐-׿]", "hi": "[ऀ-ॿ]", "th": "[฀-๿]"}
_SCRIPTS = {lang: re.compile(x) for lang, x in SCRIPTS.items()}

# The grammar of a refusal. Someone who answers (subject) will or can not do
# (negation) what is done to requests (verb), and nothing else is said of it (object): a verb of
# other uses, such as helping to think or providing food, is none. Around refusals stand phrases
# without content.
_OPEN = r"(?=\W*$|[.!?;:,]| (?:with|about|on|to|for|at|in|here|there|you|further|any|from|because|since|as|without)\b)"
_THIS = r"(?: you)?(?: with)? (?:that|this|it|these|those|such|your|any|anything|more|further)\b"
_ASKED = r"(?: you)?(?: with)? (?:an? |the |any |more |further |your |legal |financial |medical |specific |personal )*(?:answers?|opinions?|views?|responses?|comments?|repl(?:y|ies)|recommendations?|advice|guidance|information|details?|questions?|requests?|assistance|support|help|matters?|topics?|subjects?)\b"
_VERB = rf"(?:(?:help|assist|comment|advise|reply|respond|engage|speak|comply){_OPEN}|(?:answer|provide|offer|give|share|say|support|complete|fulfil|process|do)(?:{_THIS}|{_ASKED}|(?=\W*$|[.!?;]))|(?:discuss|cover|address|answer|explain|describe)(?:{_THIS}|{_ASKED}| (?:the|an?) [\w' -]+(?=\W*$|[.!?;])))"
REFUSALS = [
    rf"\b(?:i|we) (?:can ?not|can't|could not|couldn't|won't|will not|am not|are not|'m not|am unable|are unable|'m unable)(?: be)?(?: able| allowed| permitted| going| in a position)?(?: to)? {_VERB}",
    rf"\b(?:i|we)(?: am|'m| are|'re) (?:not able|unable|not allowed|not permitted) to {_VERB}",
    rf"\b(?:i|we) (?:would|'d) (?:rather|prefer) not(?: to)? {_VERB}",
    rf"\b(?:i|we) (?:must|have to|need to) (?:decline|refuse)(?: to {_VERB}|(?=\W*$|[.!?;,]))",
    r"\bfalls outside what (?:i|we) (?:may|can|am|are) (?:able to |allowed to )?(?:answer|discuss|cover|say|help)",
    r"\b(?:inappropriate|not appropriate|not right|wrong) for me to (?:discuss|comment|answer|say|advise|speak|share|offer|give|cover)\b",
    r"\bnothing (?:that )?(?:i|we)(?: am| are|'m|'re) (?:allowed|able|permitted) to (?:share|say|offer|give|add|answer)\b",
    r"\brequest (?:can't|can ?not|could not|couldn't|won't|will not) be (?:completed|answered|fulfilled|met|processed)",
    r"\b(?:guidelines|policies|policy|rules|instructions) (?:stop|prevent|keep|bar|forbid|prohibit) (?:me|us)(?: from| to)? (?:covering|cover|answer|answering|discuss|discussing|comment|commenting|say|saying|help|helping|share|sharing)",
    r"\bno answer can be (?:given|offered|provided)",
    r"\bnot enough (?:in|information|context|material|detail)\b.*\bfor me to (?:respond|answer|say)",
    r"\b(?:i|we) (?:do not|don't|lack) (?:have )?(?:access to|enough)\b.*\b(?:answer|respond|say)\b",
    r"\binstead of relying on me\b",
    r"\bje (?:ne peux|ne suis) pas\b.*\b(?:aider|répondre|fournir|commenter|autorisé|en mesure)",
    r"\bno (?:puedo|podemos) (?:ayudar|responder|ofrecer|comentar|proporcionar|contestar)",
    r"\b(?:kann|darf|können)\b.*\bnicht (?:beantworten|helfen|weiterhelfen|kommentieren)",
    r"\bnon (?:posso|possiamo) (?:aiutar|rispondere|fornire|commentare)",
    r"\bnão (?:posso|podemos) (?:ajudar|responder|fornecer|comentar)",
    r"\bkan\b.*\bniet (?:helpen|beantwoorden|geven)",
    r"(?:お答え|回答|お手伝い|対応)(?:は|を)?(?:でき|いたしかね|しかね)",
]
# Each refusal holds one of these; most answers hold none and need no grammar.
_HINTS = (
    "can't", "cannot", "can not", "could not", "couldn't", "won't", "will not", "am not", "are not", "'m not", "unable", "not able", "not allowed", "not permitted", "rather not", "prefer not", "decline", "refuse",
    "falls outside", "for me to", "nothing", "request", "guidelines", "polic", "rules", "instructions", "no answer", "enough", "access to", "relying on me", "je ne", "no puedo", "no podemos", "nicht", "non poss", "não po", "niet", "お", "回答", "対応",
)
FILLERS = [
    r"\bthanks? (?:you )?for (?:asking|your)", r"\bgood question\b", r"\b(?:sorry|apologies|unfortunately|regret)\b", r"\bplease (?:consult|contact|ask|see|speak|refer|check)\b",
    r"\bis there (?:something|anything) else\b", r"\bfeel free\b", r"\byou may (?:wish|want|like)\b", r"\bcommon (?:worry|question|concern)\b", r"\bcomes up in\b", r"\braise a (?:good |fair )?point\b",
    r"\blet me know\b", r"\bhappy to help\b", r"\b(?:as an?|i am an?|i'm an?) (?:ai|language|assistant|virtual|large)\b", r"\bto be safe\b", r"\bi hope\b",
]
_REFUSAL, _FILLER = re.compile("|".join(REFUSALS), re.S), re.compile("|".join(FILLERS))
# What goes on after a refusal in the same sentence and tells something.
_GOES_ON = re.compile(r"(?:[,;:–—-]\s*|\s)(?:so|but|however|instead|yet|therefore|then|and (?:so|then)|which|because the|since the)\s+(?=\w)|[;:–—]\s+(?=\w)")

NUMBERS = {w: n for n, w in enumerate("zero one two three four five six seven eight nine ten eleven twelve".split())}
_CLOSES = {")": "(", "]": "[", "}": "{", "”": "“", "»": "«", "」": "「", "』": "『"}
_OPENS = set(_CLOSES.values())
_MARKS = re.compile(r"```|\*\*|`|</?[a-zA-Z][a-zA-Z0-9]*(?:\s[^<>]*)?>|[()\[\]{}“”«»「」『』\"]")
_VOID = {"br", "hr", "img", "input", "meta", "link"}
_ITEM = re.compile(r"^\s*(?:[-*•–]|\d{1,2}[.)]|[a-z][.)])(?:\s+(.*))?$")
_WORD = re.compile(r"[぀-ヿ㐀-鿿가-힯]|[^\W_]+")
_LEAD_IN = re.compile(r"^\s*(?:q|question|the question is|you ask(?:ed)?|you asked whether|to repeat|your question)\s*[:\-–—]\s*|\s*\b(?:answer|a)\s*:\s*$", re.I)
# Abbreviations that something has to follow.
_GOING_ON = re.compile(r"(?:^|[\s(,])(?:(?i:vs|i\.\s?e|e\.\s?g|cf|viz|approx|incl|esp|resp|art|arts|sec|fig|figs|para|vol|chap|ch|ed|eds|pp?|mr|mrs|ms|dr|prof|z\.\s?b|d\.\s?h|bzw|p\. ?ej|par ex|bijv)|(?<=[a-z,;] )Nos?)\.$")
_STOPS = tuple(".!?。！？")
# Spaces of any kind and invisible characters.
_BLANK = "".join(chr(c) for c in range(0x3001) if chr(c).isspace()) + "".join(map(chr, [*range(0x200B, 0x2010), 0x2060, 0xFEFF]))
_WHOLE_END = re.compile(r"(?:https?://|www\.)\S+$|[\U0001F300-\U0001FAFF☀-➿✀-➿]️?$")


def is_empty(answer: str | None) -> bool:
    """Null, or nothing in it but spaces, marks or a placeholder."""
    said = " ".join(w.lower() for w in _WORD.findall(answer or ""))
    return not said or said in PLACEHOLDERS


def open_marks(text: str) -> list[str]:
    """What is opened and not closed, by a pushdown pass: fences, brackets, quotation marks of all
    kinds, bold, inline code and tags. Inside a fence or inline code nothing else counts; a
    closing mark closes what stands open inside it; one that closes nothing is ignored."""
    stack: list[str] = []
    for m in _MARKS.finditer(text):
        mark = m[0]
        if stack and stack[-1] in ("```", "`"):
            if mark == stack[-1]:
                stack.pop()
            continue
        if mark[0] == "<":
            name = mark.strip("</>").split()[0].lower()
            opener, opens = f"<{name}>", mark[1] != "/" and name not in _VOID and not mark.endswith("/>")
        else:
            opener = _CLOSES.get(mark, mark)
            opens = mark in _OPENS or (mark not in _CLOSES and opener not in stack)
            if mark == '"' and opens and text[: m.start()][-1:].isdigit():
                continue  # inches
        if opens:
            stack.append(opener)
        elif opener in stack:
            del stack[len(stack) - 1 - stack[::-1].index(opener) :]
    return stack


def is_truncated(answer: str) -> bool:
    """Breaks off: something opened is not closed, or the end is no end.

    :func:`open_marks`, then the last line: an item of a list is an end unless it is bare, falls
    short of items that are all alike, or lacks the full stop that the others have; other text
    has to end like a sentence, with whatever closes after it, or with an address or an emoji, and
    not with a bare number of a list or with dots that leave it open. A text that announces a
    number of steps has to number them. A short phrase without any punctuation that ends in a
    whole word is a reply in telegraph style.
    """
    text = answer.rstrip(_BLANK)
    if open_ := open_marks(text):
        return bool(open_)
    if text.endswith("```"):
        return False
    lines = [x for x in text.split("\n") if x.strip()]
    if not lines:
        return False
    items = [m for m in map(_ITEM.match, lines) if m]
    last = _ITEM.match(lines[-1])
    if last and len(lines) > 1:
        said = [(m[1] or "").strip() for m in items]
        sizes = [len(x.split()) for x in said]
        stopped = [bool(re.search(r"[.!?。！？;]$", x)) for x in said]
        alike = len(sizes) > 2 and len(set(sizes[:-1])) == 1 and sizes[-1] < sizes[0] and not stopped[-1]
        return not sizes[-1] or alike or (len(said) > 2 and all(stopped[:-1]) and not stopped[-1])
    bare = (re.sub(r"(?:</[a-zA-Z0-9]+>)+$", "", text) if text[-1] == ">" else text).rstrip("\"'’”»」』)]*_`")
    if bare.endswith(("..", "…")) or _GOING_ON.search(bare[-16:]):
        return True
    if text[-1] in ".)" and text[-2:-1].isdigit() and re.search(r"(?:^|[.!?:;]\s+|\n\s*)\d{1,2}[.)]$", text):
        return True
    if (steps := re.match(r"\s*(?:there are|here are)\s+(\w+)\s+(?:steps|points|reasons|things|parts|ways)", text, re.I)) and (told := re.findall(r"(?:^|\s)(\d{1,2})[.)]\s", text)):
        wanted = NUMBERS.get(steps[1].lower()) or (int(steps[1]) if steps[1].isdigit() else 0)
        if len(told) < wanted:
            return True
    if bare[-1:] in _STOPS or text[-1:] in ")]”»」』\"'>" or _WHOLE_END.search(text):
        return False
    return not re.fullmatch(r"[A-Z][\w'’-]*(?: [\w'’-]+){0,3} (?!(?:" + "|".join(FUNCTION_WORDS["en"].split()) + r")$)[^\W\d_]{3,}", text)


def is_refusal(answer: str) -> bool:
    """Declines, and says nothing else: sentences that refuse or are without content hold at least
    twice the words of the others, and none goes on to tell something after refusing."""
    text = answer.lower().replace("’", "'")
    if not any(x in text for x in _HINTS) or not _REFUSAL.search(text):
        return False
    left, refused = 0, 0
    for sentence in re.split(r"(?<=[.!?。！？])\s*(?=\S)", text):
        n = len(_WORD.findall(sentence))
        if m := _REFUSAL.search(sentence):
            told = _GOES_ON.search(sentence, m.end())
            rest = len(_WORD.findall(sentence[told.end() :])) if told and not _REFUSAL.search(sentence, told.end()) and not _FILLER.search(sentence, told.end()) else 0
            refused, left = refused + n - rest, left + rest
        elif not _FILLER.search(sentence):
            left += n
    return bool(refused) and 2 * left <= refused


class _Profiles:
    """Letter models of the languages: each letter given the two before it, counted in
    :data:`ARTICLE` and the function words and backed off to one letter before and to none."""

    def __init__(self) -> None:
        self.names = sorted(ARTICLE)
        self.counts = []
        for lang in self.names:
            c: Counter[str] = Counter()
            for w in re.findall(r"[^\W\d_]+", f"{ARTICLE[lang]} {FUNCTION_WORDS[lang]}".lower()):
                w = f"  {w} "
                c.update(w[i - n : i + 1] for i in range(2, len(w)) for n in range(3))
                c.update("^" + w[i - n : i] for i in range(2, len(w)) for n in range(3))
            self.counts.append(c)
        self.letters = len({g for c in self.counts for g in c if len(g) == 1})
        self.score = lru_cache(1 << 16)(self._score)

    def _score(self, word: str) -> np.ndarray:
        """The logarithm of the likelihood of a word under each language."""
        w, out = f"  {word} ", np.zeros(len(self.names))
        for k, c in enumerate(self.counts):
            for i in range(2, len(w)):
                p = 1 / (self.letters + 1)
                for n, trust in ((0, 20), (1, 4), (2, 2)):
                    p = (c[w[i - n : i + 1]] + trust * p) / (c["^" + w[i - n : i]] + trust)
                out[k] += math.log(p)
        return out


@cache
def _profiles() -> _Profiles:
    return _Profiles()


def languages(text: str | None) -> tuple[str, ...]:
    """The languages a text may be in: by script, else by function words, else by its letters:
    of the languages that share the lead in function words, or with less than two of these, of all,
    those not much less likely than the best. None for a text without letters or of names only."""
    if not text:
        return ()
    if not text.isascii():
        letters = max(1, sum(map(str.isalpha, text)))
        for lang, script in _SCRIPTS.items():
            if len(script.findall(text)) >= 0.15 * letters:
                return (lang,)
    words = Counter(re.findall(r"[^\W\d_]+", text.lower()))
    if not words:
        return ()
    votes: Counter[str] = Counter()
    for w, n in words.items():
        for lang in _SPEAKS.get(w, ()):
            votes[lang] += n
    most = max(votes.values(), default=0)
    likely = [name for name in FUNCTION_WORDS if most >= 2 and 1.3 * votes[name] >= most]
    if len(likely) == 1:
        return (likely[0],)
    if not likely and not any(w[0].islower() for w in re.findall(r"[^\W\d_]{3,}", text)):
        return ()  # names
    model = _profiles()
    scores = dict(zip(model.names, sum(n * model.score(w) for w, n in words.items()), strict=True))
    margin = max(MARGIN, MARGIN_LETTER * sum(len(w) * n for w, n in words.items()))
    best = max(scores[name] for name in likely or scores)
    if likely:
        return tuple(name for name in likely if scores[name] >= best - MARGIN)
    return tuple(name for name in model.names if votes[name] or scores[name] >= best - margin)


def language(text: str | None) -> str | None:
    """The language of a text; null where too little speaks for one against the others."""
    found = languages(text)
    return found[0] if len(found) == 1 else None


def _tokens(text: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(re.sub(r"(?<=\d)[,.](?=\d{3}\b)", "", text))]


def tiles(a: list[str], b: list[str], least: int = 2) -> tuple[int, int]:
    """Greedy string tiling of ``a`` by ``b``: the longest common runs first, each word of ``a`` in
    one tile; runs of ``b`` may serve again, so that repeats are covered. How many words of ``a``
    and of ``b`` are covered by tiles of at least ``least`` words."""
    at: dict[str, list[int]] = {}
    for j, w in enumerate(b):
        at.setdefault(w, []).append(j)
    # Of each place of a: the longest run of b from there, and where in b it is.
    longest, ahead = [(0, 0)] * (len(a) + 1), {}
    for i in range(len(a) - 1, -1, -1):
        ahead = {j: ahead.get(j + 1, 0) + 1 for j in at.get(a[i], ())}
        longest[i] = max(((n, -j) for j, n in ahead.items()), default=(0, 0))
    heap = [(-n, i, -j) for i, (n, j) in enumerate(longest) if n >= least]
    heapify(heap)
    free_a, used_b, covered = [True] * (len(a) + 1), [False] * len(b), 0
    free_a[len(a)] = False
    while heap:
        n, i, j = heappop(heap)
        n = -n
        if not free_a[i]:
            continue
        fits = n if free_a[i + n - 1] else next(k for k in range(n) if not free_a[i + k])
        if fits < n:  # a longer tile has taken the end of it
            if fits >= least:
                heappush(heap, (-fits, i, j))
            continue
        free_a[i : i + n] = [False] * n
        used_b[j : j + n] = [True] * n
        covered += n
    return covered, sum(used_b)


def tokens_to_compare(answer: str) -> str:
    """The words of an answer but for a lead-in, with single spaces."""
    return " ".join(_tokens(_LEAD_IN.sub("", _LEAD_IN.sub("", answer))))


#: An answer is a copy if of its words at most this share (or two) is covered by no tile, and of
#: the question's at least this share by some.
OWN, TAKEN = 0.1, 0.6


def copies(question: str, answer: str) -> bool:
    """Nothing but the question, once or repeated, but for a lead-in and a word or two."""
    return _copied(" ".join(_tokens(question)), tokens_to_compare(answer))


def _copied(question: str, answer: str) -> bool:
    q, a = question.split(), answer.split()
    own = max(2, OWN * len(a))
    asked = set(q)
    if not q or not a or sum(w not in asked for w in a) > own:
        return False
    covered, taken = tiles(a, q)
    return len(a) - covered <= own and taken >= TAKEN * len(q)


def _answer_alone(x: str | None) -> tuple[str | None, tuple[str, ...], str]:
    if is_empty(x):
        return "empty", (), ""
    return "refusal" if is_refusal(x) else "truncated" if is_truncated(x) else None, languages(x), tokens_to_compare(x)


def _question_alone(x: str | None) -> tuple[str | None, tuple[str, ...], str]:
    return None, languages(x), " ".join(_tokens(x or ""))


def _seen_alone(texts: DataFrame, text: str, see: Callable[[str | None], tuple[str | None, tuple[str, ...], str]]) -> DataFrame:
    """``texts`` with ``(defect, langs, words)`` in place of the text. A map over batches, since the
    optimizer would move a filter on the result of a function of a column below the shuffle and
    work the function out a second time."""
    rest = [f for f in texts.schema.fields if f.name != text]

    def seen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.drop(columns=text).assign(**dict(zip(("defect", "langs", "words"), zip(*map(see, pdf[text]), strict=True) if len(pdf) else ([], [], []), strict=True)))

    return texts.mapInPandas(seen, T.StructType([*rest, T.StructField("defect", T.StringType()), T.StructField("langs", T.ArrayType(T.StringType())), T.StructField("words", T.StringType())]))


@F.pandas_udf(T.BooleanType())
def _copies(questions: pd.Series, answers: pd.Series) -> pd.Series:
    return pd.Series([a is not None and _copied(q, a) for q, a in zip(questions, answers, strict=True)], dtype=bool)


def pair_defects(questions: DataFrame, question_id: str, key: str, question: str, answers: DataFrame, answer_key: str, answer: str) -> DataFrame:
    """``(question_id, defect_type)`` of each question whose answer is defective.

    The defect is the first that holds of: ``empty``, ``copies_question``, ``refusal``,
    ``truncated``, ``other_language``. A question with a null key or without an answer row is no
    pair; a null or blank question is copied by no answer and has no language. Repeated rows
    with the same content are one; both sides may have other columns. A key that many questions
    share is joined under Spark's own skew handling; the answer's part is done before the join.
    """
    a = answers.select(F.col(answer_key).alias("_key"), F.col(answer).alias("_answer")).where("_key is not null").distinct()
    a = _seen_alone(a, "_answer", _answer_alone)
    a = a.withColumn("_different", F.array_distinct(F.split("words", " "))).withColumn("_own", F.greatest(F.lit(2.0), OWN * F.size(F.split("words", " "))))
    q = questions.select(F.col(question_id).alias("question_id"), F.col(key).alias("_key"), F.col(question).alias("_question")).where("_key is not null").distinct()
    q = _seen_alone(q, "_question", _question_alone).select("question_id", "_key", F.col("langs").alias("_q_langs"), F.col("words").alias("_q"))
    # A copy has few words of its own, and so few different ones; only such answers are tiled.
    near = (F.col("_q") != "") & (F.col("words") != "") & (F.size(F.array_except("_different", F.split("_q", " "))) <= F.col("_own"))
    other = (F.size("_q_langs") > 0) & (F.size("langs") > 0) & ~F.arrays_overlap("_q_langs", "langs")
    pairs = q.join(a, "_key").withColumns({"_other": other, "_near": near}).where("defect is not null or _near or _other")
    pairs = pairs.withColumn("_copy", _copies("_q", F.when(F.col("_near"), F.col("words"))))
    found = (
        F.when(F.col("defect") == "empty", "empty")
        .when(F.col("_copy"), "copies_question")
        .when(F.col("defect").isNotNull(), F.col("defect"))
        .when(F.col("_other"), "other_language")
    )
    return pairs.select("question_id", F.explode(F.filter(F.array(found), lambda x: x.isNotNull())).alias("defect_type")).distinct()
