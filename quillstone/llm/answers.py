"""Broken prompt and response pairs: each defective answer with its side and kind of defect.

The first that holds: ``empty``, ``refusal``, ``copy``, ``language``, ``truncated``.

* A copy is proposed by the compressor: the answer, compressed with the prompt as zstandard dictionary, takes at
  most ``COPY_SHARE`` of what it takes alone. What it proposes has to be the prompt, its passage or at least two
  whole sentences of it (case, white space, quotes, a leading ``Text:``, the instruction and the end marker aside).
* Refusals and languages are told by dictionaries: phrases that decline, in an answer without any whole
  row; the script of the letters, and function words of each language, weighted by how few languages share them.
* Truncation is predicted from the terminal context: an averaged perceptron over what stands at the end of the last row
  (quote state, fields so far, the last signs), fitted on the driver on answers that close with the end marker, as
  they are and cut at random places (at most ``FIT_ROWS`` answers of the table, in the order of their hashes, and
  rows composed here). What it predicts counts if there is no end marker and the last row is no whole row.

Edge cases: a null answer is empty; ``### END`` alone is sound; a null prompt has no passage, so neither
copy nor language applies; repeated rows give repeated defects; an empty table gives an empty result.
"""

from __future__ import annotations

import random
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.scanned import AveragedPerceptron

END_MARK = "### END"
#: A suspected copy shrinks to at most this share of what it takes without the prompt.
COPY_SHARE = 0.6
#: Answers of the table that train the model of terminal contexts, at most.
FIT_ROWS = 1000

#: Words that say "nothing", reduced to letters and digits.
NOTHING = frozenset(
    """none null nil na nan nothing empty void noevents noevent noeventsfound noeventfound noeventidentified noeventsidentified
    noaopidentified notapplicable notavailable noanswer nooutput noresult noresults blank undefined unknown keine keiner
    nichts ninguno ninguna nada aucun aucune rien""".split()
)
#: Sentences that say "nothing".
NOTHING_SAID = re.compile(
    r"""\W*(?:(?:there\ (?:is|are|was|were)\ )?(?:no|not\ any)\ (?:\w+\ ){0,3}?(?:events?|rows?|outcomes?|findings?|results?|information)\b(?:\ [\w-]+){0,8}
    | (?:there\ (?:is|was)\ )?nothing\ (?:to\ \w+|found|relevant|here|of\ note|applicable|identified|described)(?:\ [\w-]+){0,5} | none\ (?:found|identified|described|reported|given|stated|present)(?:\ [\w-]+){0,5})\W*""",
    re.I | re.X,
)
#: Phrases by which an answer declines.
REFUSALS = re.compile(
    r"""\b(?: i['’]?\ ?a?m\ (?:\w+\ ){0,2}sorry | (?:so|very|really|truly|terribly|deeply)\ sorry | ^\W*sorry\b(?=\W*$|\ ?[,.;:!–—-]|\ (?:but|i|we|this|that|for|about|to|no|can)\b) | apolog\w+ | regret(?:s|ted|tably|fully)?\b | unfortunately
    | (?:can|could|will|would|must|may|do|does|am|is|are)\ ?(?:not|n['’]t)\b.{0,40}?\b(?:help|assist|provid\w+|giv\w+|answer|comply|list|judge|produc\w+|extract|do\ that|discuss\w*|share|comfortable|appropriate|able|allowed|permitted|go\ into|continue|generat\w+|engage)
    | cannot | can['’]?t\b | can\ not\b | wo\ ?n['’]t\b | unable\ to | not\ able\ to | not\ comfortable | rather\ not | prefer\ not | (?:i|we|must|to|will|politely|respectfully)\ declin\w+ | declin\w+\ to | (?:i|we|must|to)\ refus\w+ | refus\w+\ to
    | not\ be\ appropriate | against\ (?:my|our|the)\ (?:guidelines|policy|policies|rules) | outside\ (?:of\ )?what\ i | stay\ silent | remain\ silent
    | as\ an?\ (?:ai|language\ model|assistant|artificial) | no\ answer\ can\ be | not\ (?:allowed|permitted|willing)
    | es\ tut\ mir\ leid | leider | ich\ kann\ (?:das|diese|nicht|keine) | lo\ siento | lamento | no\ puedo | désolé\w* | je\ ne\ (?:peux|puis|suis) | malheureusement
    | mi\ dispiace | purtroppo | non\ (?:posso|sono\ in\ grado|possiamo) | mi\ scus\w+ | desculp\w+ | sinto\ muito | infelizmente | não\ (?:posso|consigo|podemos|me\ é\ possível)
    | het\ spijt | helaas | ik\ kan\ (?:dit|deze|hier|niet|geen) | tyvärr | jag\ kan\ inte | desværre | jeg\ kan\ ikke | beklager | niestety | przepraszam | nie\ mog[ęe]
    | извините | к\ сожалению | не\ могу | 抱歉 | 对不起 | 對不起 | 无法 | 無法 | 申し訳 | できません | 죄송 | 할\ 수\ 없 )""",
    re.I | re.X,
)
#: Function words by language.
FUNCTION_WORDS = {
    "en": "the of and in to a by at for with from after over via through was were is are that which on show shows showed exposed than but no not did had has have this these we as between days weeks response leading change linked",
    "de": "der die das und in im den dem des ein eine einer eines einem von vom zu zum zur mit bei nach auf für über ab durch wegen aus an am war wurde werden wird nicht ohne wenn sobald oder auch sich es ist tage stunden",
    "fr": "le la les l un une des du de d et en dans par chez avec pour sur après dès à au aux qui que est a été ne pas sans mais lorsque même cette ce ces nous pendant jours heures causée",
    "es": "el la los las un una unos unas de del y en con por para desde al a que se no sin pero cuando es fue después tras durante más estos esta este nos días horas causada",
    "it": "il lo la gli le un uno una di del della dei delle e in nel nella con per da dal che si non senza ma quando è dopo durante giorni ore",
    "pt": "o a os as um uma de do da dos das e em no na nos nas com por para desde que se não sem mas quando é após durante dias horas",
    "sv": "och att det som en ett på är av för med till den inte om vid efter från hos eller var när under dagar timmar genom utan ökade minskade",
    "da": "og at det som en et på er af for med til den ikke om ved efter fra hos eller var når under dage timer gennem uden",
    "pl": "i w na z do się nie jest to po przez oraz dla od za przy lub była był po dniach godzin u bez",
    "tr": "ve bir bu ile için olarak sonra gün saat olan da de değil veya",
    "nl": "de het een van en in op met bij na voor door uit aan is was werd worden niet zonder maar wanneer tot dagen uren",
}
_SHARED: dict[str, list[str]] = {}
for _lang, _words in FUNCTION_WORDS.items():
    for _word in dict.fromkeys(_words.split()):
        _SHARED.setdefault(_word, []).append(_lang)

_ASCII_LETTER, _NON_ASCII = re.compile(r"[A-Za-z]"), re.compile(r"[^\x00-\x7f]")
_ALNUM = re.compile(r"[^\W_]+")
_WORD = re.compile(r"[^\W\d_]+")
_QUOTES = re.compile(r"[\"'“”„‟«»‘’‚`´]")
_ENDING = re.compile(r"\s*###\s*END\s*$", re.I)
_FIELD = r'[ \t\r]*(?:"(?:[^"]|"")*"[ \t\r]*|[^",\n]*)'
_WHOLE_ROW = re.compile(rf"{_FIELD},{_FIELD},{_FIELD}")
_ROW_START = re.compile(rf"({_FIELD}),({_FIELD}),(.*)", re.S)
_TYPE = re.compile(r'[\s"]*(?:MIE|KE|AO)[\s"]*$', re.I)


@lru_cache(maxsize=64)
def passage_of(prompt: str) -> tuple[str, str]:
    """(instruction, passage): the passage follows the last line ``Text:``; without one it is the prompt."""
    at = [m.end() for m in re.finditer(r"^[ \t]*Text:[ \t]*\r?$\n?", prompt, re.M)]
    return (prompt[: at[-1]], prompt[at[-1] :]) if at else ("", prompt)


def script_of(text: str) -> str | None:
    """The script of most of the letters; none without letters. Kana, Han and Hangul count as scripts of their own."""
    plain = len(_ASCII_LETTER.findall(text)) if not text.isascii() else int(any(map(str.isalpha, text)))
    counts: dict[str, int] = {"LATIN": plain} if plain else {}
    for ch in "" if text.isascii() else _NON_ASCII.findall(text):
        if ch.isalpha():
            name = _script(ch)
            counts[name] = counts.get(name, 0) + 1
    return max(counts, key=lambda x: (counts[x], x), default=None)


@lru_cache(maxsize=1 << 14)
def _script(ch: str) -> str:
    return unicodedata.name(ch, "OTHER").split()[0]


def language_scores(text: str) -> dict[str, float]:
    """Language -> weight of its function words; a word of several languages counts in part for each."""
    score: dict[str, float] = {}
    for w in _WORD.findall(text.lower()):
        langs = _SHARED.get(w)
        if langs:
            for lang in langs:
                score[lang] = score.get(lang, 0.0) + 1.0 / len(langs)
    return score


def language_of(text: str) -> str | None:
    """The language whose function words carry the most weight; none if they are too few or level."""
    ranked = sorted(language_scores(text).items(), key=lambda x: (-x[1], x[0]))
    if not ranked or ranked[0][1] < 1.0 or (len(ranked) > 1 and ranked[0][1] < ranked[1][1] * 1.15):
        return None
    return ranked[0][0]


def _flat(text: str) -> str:
    bare = _QUOTES.sub("", _ENDING.sub("", text)).casefold()
    return "".join(bare.split())


def is_empty(answer: str | None) -> bool:
    if answer is None:
        return True
    if answer.strip() == END_MARK:
        return False
    body = _ENDING.sub("", answer)
    said = "".join(_ALNUM.findall(body.casefold()))
    return said in NOTHING or not said or bool(NOTHING_SAID.fullmatch(" ".join(body.split())))


def lines_of(answer: str) -> list[str]:
    return [x for x in answer.split("\n") if x.strip() and x.strip() != END_MARK]


def is_row(line: str) -> bool:
    return bool(_WHOLE_ROW.fullmatch(line.strip()))


def is_refusal(answer: str) -> bool:
    """Declines, and gives no row whose second field is an event type."""
    for line in lines_of(answer):
        m = _ROW_START.match(line.strip())
        if m and _TYPE.match(m.group(2)):
            return False
    return bool(REFUSALS.search(" ".join(answer.split())))


def shrinks(answer: str, prompt: str) -> bool:
    """Whether the answer nearly vanishes when compressed with the prompt as dictionary."""
    a, p = " ".join(_QUOTES.sub("", answer).lower().split()).encode(), " ".join(_QUOTES.sub("", prompt).lower().split()).encode()
    if len(a) < 8 or len(p) < 8:
        return True
    plain = len(zstandard.ZstdCompressor(level=3).compress(a))
    tied = len(zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(p, dict_type=zstandard.DICT_TYPE_RAWCONTENT)).compress(a))
    return tied <= COPY_SHARE * plain


def is_copy(answer: str, prompt: str) -> bool:
    if answer.strip() == END_MARK or not shrinks(answer, prompt):
        return False
    instruction, passage = passage_of(prompt)
    said, whole, head = _flat(answer), _flat(passage), _flat(instruction)
    if not said or not whole:
        return False
    for lead in (head, "text:"):
        if lead and said.startswith(lead):
            said = said[len(lead) :]
    if said == whole:
        return True
    sentences = {s for s in (_flat(x) for x in re.split(r"(?<=[.!?])\s+|\n+", passage)) if s}
    if not sentences:
        return False
    at, count, lengths = 0, 0, sorted({len(s) for s in sentences}, reverse=True)
    while at < len(said):
        for n in lengths:
            if said[at : at + n] in sentences:
                at += n
                count += 1
                break
        else:
            return False
    return count >= 2


def descriptions(answer: str) -> str:
    """The third fields of the answer's rows."""
    out = []
    for line in lines_of(answer):
        m = _ROW_START.match(line.strip())
        if m and _TYPE.match(m.group(2)):
            out.append(m.group(3))
    return "\n".join(out)


@lru_cache(maxsize=64)
def _written(passage: str) -> tuple[str | None, str | None]:
    """Script and language of a passage, which both sides of a pair share."""
    return script_of(passage), language_of(passage)


def is_other_language(answer: str, prompt: str) -> bool:
    """The descriptions are written in another script than the passage, or other function words outweigh those of its language."""
    said, passage = descriptions(answer), passage_of(prompt)[1]
    if not said:
        return False
    (ours, language), theirs = _written(passage), script_of(said)
    if theirs != ours and theirs is not None and ours is not None:
        return True
    scores = language_scores(said)
    if language is None or not scores:
        return False
    top = max(scores, key=lambda x: (scores[x], x))
    # it does not matter which of the other languages it is
    return top != language and scores[top] >= 1.0 and scores[top] >= 1.15 * scores.get(language, 0.0)


class TerminalModel:
    """Tells from the end of an answer's last row whether it was cut off."""

    WHOLE, CUT = LABELS = "whole", "cut"

    def __init__(self, answers: list[str], seed: int = 5):
        self.model = AveragedPerceptron()
        rng = random.Random(seed)
        words = "liver injury was seen in mice at the dose of zinc oxide and after days growth fell by one half".split()
        said = lambda lo, hi: " ".join(rng.choice(words) for _ in range(rng.randint(lo, hi)))
        quote = lambda x: rng.choice(['"{}"', '"{}"', "{}"]).format(x)
        composed = [",".join((quote(said(1, 3)), quote(rng.choice(["MIE", "KE", "AO"])), quote(rng.choice(["", "a ""b"" ", "1,5 "]) + said(2, 9)))) for _ in range(300)]
        examples = []
        rows = [r for a in answers for r in lines_of(a)] + composed
        for row in rows:
            if not is_row(row):
                continue
            examples.append((self.features(row), self.LABELS, self.WHOLE))
            for _ in range(2):
                part = row[: rng.randint(1, max(len(row) - 1, 1))]
                if not is_row(part):  # an unquoted description that ends early is a whole row still
                    examples.append((self.features(part), self.LABELS, self.CUT))
            examples.append((self.features(said(1, 12) + rng.choice(["", ".", ",", ":"])), self.LABELS, self.CUT))
        self.model.learn(examples, 6, seed)

    @staticmethod
    def features(row: str) -> list[str]:
        s = row.strip()
        inside, commas, start = False, 0, 0
        for i, ch in enumerate(s):
            if ch == '"':
                inside = not inside
            elif ch == "," and not inside:
                commas, start = commas + 1, i + 1
        kind = lambda ch: "L" if ch.isalpha() else "D" if ch.isdigit() else "S" if ch.isspace() else ch
        end = "".join(map(kind, s[-3:]))
        last = s[start:].strip()
        field = "none" if not last else "open" if inside else "closed" if last.endswith('"') else "bare"
        state = f"{field}{min(commas, 3)}"
        return ["b", f"s{state}", f"c{min(commas, 3)}", f"f{field}", f"e{end[-1:]}", f"se{state}{end[-1:]}", f"t{end}", f"l{state}{min(len(last), 3)}", f"q{s.count(chr(34)) % 2}{min(commas, 3)}"]

    def cut(self, row: str) -> bool:
        s = self.model.scores(self.features(row), self.LABELS)
        return s[self.CUT] > s[self.WHOLE]


@lru_cache(maxsize=2)
def terminal_model(answers: tuple[str, ...] = ()) -> TerminalModel:
    return TerminalModel(list(answers))


def is_truncated(answer: str, model: TerminalModel) -> bool:
    if any(x.strip() == END_MARK for x in answer.split("\n")) or _ENDING.search(answer):
        return False
    rows = lines_of(answer)
    return bool(rows) and model.cut(rows[-1]) and not is_row(rows[-1])


def defect_of(answer: str | None, prompt: str | None, model: TerminalModel | None = None) -> str | None:
    """The first defect of an answer, or none."""
    if is_empty(answer):
        return "empty"
    copied = bool(prompt) and is_copy(answer, prompt)
    if not copied and is_refusal(answer):  # a copy gives back the prompt, it declines nothing
        return "refusal"
    if copied:
        return "copy"
    if prompt and is_other_language(answer, prompt):
        return "language"
    return "truncated" if is_truncated(answer, model or terminal_model()) else None


def _closed_answers(preds: DataFrame) -> tuple[str, ...]:
    """At most ``FIT_ROWS`` answers with rows that close with the end marker, in the order of their hashes."""
    gold = preds.where(F.col("gold").rlike(r",[\s\S]*### END\s*$")).select(F.col("gold").alias("a"))
    rows = gold.orderBy(F.xxhash64("a"), "a").limit(FIT_ROWS).collect()
    return tuple(r["a"] for r in rows)


def defective_answers(preds: DataFrame) -> DataFrame:
    """pair_id, side (gold or pred), defect; one pass, no shuffle (and one for the rows that train the model)."""
    model = terminal_model(_closed_answers(preds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sides, defects = [], [], []
            for key, prompt, *answers in zip(*(batch.column(i).to_pylist() for i in range(4))):
                for side, answer in zip(("gold", "pred"), answers):
                    defect = defect_of(answer, prompt, model)
                    if defect:
                        ids.append(key), sides.append(side), defects.append(defect)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sides, pa.string()), pa.array(defects, pa.string())], names=["pair_id", "side", "defect"])

    return preds.select("pair_id", "prompt", "gold", "pred").mapInArrow(run, "pair_id bigint, side string, defect string")
