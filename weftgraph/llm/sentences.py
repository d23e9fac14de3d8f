"""Sentence boundaries across languages and scripts.

A text is cut at blank lines; agenda lines, notes of correction and speaker headings at the top of a block are units of
their own. In the rest, brackets and quotations are paired first, and boundaries are only sought outside them:

* spaced scripts: a lattice of terminators (all that Unicode calls sentence terminals). Each full stop is a node whose
  edges (ends a unit, or doesn't) are chosen by the word before it, the word after it past any bracketed remark, and
  whether the block has letter case at all;
* spaceless scripts: where no terminator stands, the runs around a gap are segmented over a lattice of dictionary words
  with costs, and the gap is classified by the final particle before it and the opening word after it. In Thai and Lao a
  gap is white space; in Chinese and Japanese white space, or any place after a polite ending or a question particle.

The rules look at the characters, never at a language label, so that mixed texts and wrong labels do no harm. The
dictionaries are those of the installed Unicode library, or the caller's (``dictionaries.py``); the lists below are function
words, titles, months and the like of the languages at large.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.dictionaries import Lexicon, installed_lexicon

# --- fixed values: words and marks of the languages -------------------------------------------------------------------
#: Titles and abbreviations that are never the last word of a sentence when a full stop follows.
NEVER = frozenset(
    "mr mrs ms messrs dr prof st hon gen capt cpt col maj lt sgt cpl cmdr adm rev gov sen rep pres supt insp mt vs al i.e e.g a.m viz "
    "hr fr frl hrn dipl ing cf vgl bzw zw d.h z.b u.a o.ä z.t s.o s.u i.d.r gem mio mrd vors ff bd inkl exkl ggf evtl sog "
    "m mm mme mmes mlle mgr env c.-à-d p.ex ex sr sra srta dra dña ud uds lic arq ej p.ej usf ca डॉ पृ क्र श्री सं नं प्रो น ดร นพ พ.ศ ค.ศ".split()
)
#: Not the last word if a number or section sign follows.
BEFORE_NUMBER = frozenset("p pp para vol ch chap sec no nr abs art s nos núm num pág pag aprox approx ca env fig tab ed bd ziff kap cap t lit".split())
#: May end a sentence, though they are abbreviations.
EITHER = frozenset("etc usw jan feb mar apr jun jul aug sep sept oct nov dec p.m inc ltd co corp jr".split())
#: Before a number with a full stop: "this, and 2. that".
LINKING = frozenset("and or und oder et ou y e o".split())
#: German nouns after an ordinal number.
AFTER_ORDINAL = frozenset("mal januar februar märz april mai juni juli august september oktober november dezember jahrhundert jahr woche tag kapitel auflage platz stock klasse lesung sitzung wahlperiode vors".split())
#: In texts without capitals: words that go on with a sentence after one of EITHER.
GOES_ON = frozenset("and or und oder et ou y but".split())
#: A capitalised word that begins a sentence rather than being a name, after a single letter ("plan B. It works").
STARTERS = frozenset(
    "the a an it he she they we you this that these those there then thus so but and if when while after before in on at for no not what who why how "
    "der die das ein eine es er sie wir ihr dies dieser dann doch aber und wenn im am le la les un une il elle ils elles nous vous on ce cette mais et si puis "
    "el los las una él ella ellos esto este esta pero y cuando".split()
)
#: The last word of a line that ends in a colon and reports speech.
SAYING = frozenset("said say says asked asks told replied added sagte sagt fragte erklärte antwortete dit demande demanda répondit déclara dijo dice preguntó respondió कहा पूछा".split())
#: A line with one of these words is a clause, not a speaker's name.
PRONOUNS = frozenset("i we he she it they you us me him them ich wir er es ihr ihnen uns mir je nous vous il elle ils elles on yo nosotros ella ellos nos मैं हम उन्होंने".split())

PAIRS = {"(": ")", "[": "]", "（": "）", "〔": "〕", "{": "}", "【": "】"}
QUOTES = {"“": "”", "„": "“", "«": "»", "「": "」", "『": "』"}

#: Polite particles and question words that end a Thai clause.
THAI_FINAL = frozenset("ครับ ค่ะ คะ จ้ะ จ้า จ๊ะ ขอรับ ฮะ นะครับ นะคะ นะค่ะ".split())
THAI_QUESTION = frozenset("ไหม มั้ย หรือเปล่า หรือยัง หรือไม่".split())
#: Words with which a Thai or Lao clause goes on after a space: relatives, conjunctions, prepositions.
SOUTHEAST_GOES_ON = frozenset("เพราะ เพราะว่า เนื่องจาก ที่ ซึ่ง อัน ว่า และ หรือ แล้ว จึง ก็ กับ ของ โดย ด้วย เพื่อ จาก ถึง แก่ ต่อ บน ใต้ ตั้งแต่ จน จนถึง จนกระทั่ง ระหว่าง เช่น ได้แก่ คือ เป็น รวมทั้ง รวมถึง ตลอดจน พร้อม พร้อมทั้ง เรื่อง เกี่ยวกับ ทั้ง กว่า ขณะที่ ในขณะที่ ๆ ແລະ ຫຼື ທີ່ ເຊິ່ງ ເພາະ ວ່າ ຂອງ ກັບ ເພື່ອ ຈາກ ແລ້ວ ຈຶ່ງ".split())
#: A clause that ends in one of these isn't complete: prepositions, conjunctions, titles, question openers, words before a number.
SOUTHEAST_OPEN_END = frozenset("เพราะ ที่ ซึ่ง ว่า ทำไม ดร นาย นาง นางสาว คุณ ข้อ ตามข้อ มาตรา วันที่ ในวันที่ เวลา เป็น คือ จาก หน้า เรื่อง ของ ใน จึง โดย ด้วย กับ ภายใน หลัง ก่อน และ หรือ แต่ เพื่อ ตาม ถึง แก่ น ທີ່ ເພາະ ວ່າ ຂອງ ໃນ ກັບ ແລະ ຫຼື".split())
#: Openings: pronouns, titles, question words, requests, times, connectives, and the heads of names of persons and bodies.
THAI_OPENING = frozenset("ผม ดิฉัน ฉัน เรา พวกเรา เขา เธอ มัน พวกเขา ท่าน คุณ นาย นาง นางสาว ดร ใคร อะไร ทำไม เมื่อ เมื่อวาน วันนี้ พรุ่งนี้ ขณะนี้ ตอนนี้ ต่อมา จากนั้น ดังนั้น อย่างไรก็ตาม นอกจากนี้ แต่ ถ้า หาก ขอ ขอบคุณ โปรด กรุณา เชิญ ไม่ นี่ นั่น ใน ตาม สำหรับ รัฐบาล รัฐมนตรี กระทรวง กรม สภา คณะ คณะกรรมการ สำนัก สำนักงาน ประธาน พรรค ฝ่าย ฝ่ายค้าน ประชาชน บริษัท ตำรวจ ศาล การ ความ ที่ประชุม".split())
#: After a clause with one of these, words of another script are what is quoted.
THAI_QUOTING = frozenset("อ่าน กล่าว พูด บอก ถาม ตอบ เขียน".split())
LAO_OPENING = frozenset("ຂ້ອຍ ຂ້າພະເຈົ້າ ພວກເຮົາ ເຮົາ ເຂົາ ລາວ ເຈົ້າ ທ່ານ ເປັນຫຍັງ ມື້ນີ້ ມື້ອື່ນ ແຕ່ ດັ່ງນັ້ນ ຂໍ ກະລຸນາ ບໍ່ ລັດຖະບານ".split())
#: A Thai phrase of a preposition and numbers stands before its clause.
LEAD = re.compile(r"\s*(?:ตาม|ใน|เมื่อ|ณ|ตั้งแต่|ภายใน)[ก-๎]*\s*[\d.,:/]+(?:\s*[ก-๎]{1,12}\s*[\d.,:/]+)*(?:\s*น\.?)?\s*\Z")

#: Polite endings, after which what isn't a particle begins anew; and plain ones, which need white space after them.
JA_POLITE = ("でしょうか", "ましたか", "ませんか", "ますか", "ですか", "でしょう", "ましょう", "ました", "ません", "でした", "です", "ます")
JA_PLAIN = ("である", "だった", "なかった", "だ", "た", "る", "う", "く", "す", "つ", "ぬ", "ぶ", "む", "ぐ", "い")
JA_TOPIC = frozenset("は が も".split())
JA_OPENING = frozenset("私 僕 彼 彼女 我々 これ それ あれ この その あの ここ そこ なぜ どう 誰 何 今日 明日 昨日 今 しかし また そして だから ところが では はい いいえ".split())
#: A clause may end in one of these; before an opening word or white space it does.
ZH_FINAL = ("了", "吗", "呢", "吧", "啊", "过", "的")
ZH_QUESTION = ("吗", "呢", "吧")
ZH_OPENING = frozenset("我 你 您 他 她 它 我们 你们 他们 她们 咱们 这 那 这是 那是 这些 那些 为什么 怎么 谁 什么 今天 明天 昨天 现在 但是 但 可是 不过 然而 因此 所以 于是 另外 如果 虽然 请 谢谢 不 是的 天气 大家 有人 没有".split())

AGENDA = re.compile(r"[^\S\n]*(?:a?genda item|t?agesordnungspunkt|p?oint|p?unto|म?द)[^\S\n]+\d+[^\S\n]*[:：][^\n]*|[^\S\n]*(?:日?程第[^\S\n]*\d+|议?程第[^\S\n]*\d+[^\S\n]*项|ร?ะเบียบวาระที่[^\S\n]*\d+)[^\n]*", re.I)
NOTE = re.compile(r"[^\S\n]*(?:corrected version|version rectifiée|berichtigte fassung|versión corregida|訂正版|更正版|修正版|订正版|更正本|संशोधित प्रति|ฉบับแก้ไข)[^\S\n]*[.。]?[^\S\n]*(?=\n|\Z)", re.I)
#: Called a terminal by Unicode, but a reader takes it for a comma.
NOT_FINAL = "၊"
# ----------------------------------------------------------------------------------------------------------------------

#: Every sentence terminal but the full stop, by the Unicode property.
TERMINALS = "".join(c for c in regex.findall(r"\p{STerm}", "".join(map(chr, [*range(0xD800), *range(0xE000, 0x11FFF)]))) if c not in "." + NOT_FINAL)
#: Marks after which a sentence may go on in small letters.
ASKING = frozenset("?!")
FINAL_MARKS = frozenset(TERMINALS) - ASKING
T = re.escape(TERMINALS)
CJK = "ぁ-ヿ一-鿿々㐀-䶿"
BLANK = re.compile(r"\n[^\S\n]*\n\s*")
POLITE = "(?:" + "|".join(JA_POLITE) + ")(?:か|ね|よ)*"
#: Common terminals; the others only stand beside letters of the scripts between these bounds, and a class of them all is slow.
COMMON_TERMINALS = "!?\u2024‼⁇⁈⁉‽।॥。！？｡．"
OTHER_SCRIPTS = re.compile(r"[\u0530-\u08ff\u0d00-\u0dff\u0f00-\u1cff\u2c80-\u2dff\ua4d0-\uabff\ufe00-\ufe7f\U00010000-\U00011fff]|[\u2e00-\u2e7f]")
#: What may matter in a text without letters of spaceless scripts, with common terminals alone and with all.
SPACED_TOKEN, ANY_SPACED_TOKEN = (re.compile(rf"[.{re.escape(x)}|…()\[\]（）〔〕{{}}【】“”„«»「」『』\"]") for x in (COMMON_TERMINALS, TERMINALS))
SPACELESS = re.compile(rf"[\u0e00-\u0eff{CJK}]")
PAIRED = re.compile(r"[()\[\]（）〔〕{}【】“”„«»「」『』\"]")
TOKEN = re.compile(
    rf"\.{{2,}}|…+|[.{T}|]|[()\[\]（）〔〕{{}}【】“”„«»「」『』\"]"
    r"|(?<=[฀-\u0eff])\s+(?=\S)|(?<=[A-Za-z0-9)\]])\s+(?=[เแโใไก-ฮ\u0e80-\u0eff])"
    rf"|(?<=[{CJK}])\s+(?=[^\s{T}])"
    rf"|{POLITE}(?=[一-鿿々ぁ-ゖァ-ヺ])(?!が|ので|のに|から|けれ|けど|し|と|か|ね|よ|な|の|は|ば|も|って|まし|ませ)"
    r"|[吗呢吧了](?=[一-鿿])"
)
SPACE = re.compile(r"\s*")
WORD_BEFORE = re.compile(r"[^\s()\[\]（）〔〕“”„«»「」『』\"¿¡,;:–—*/]*\Z")
WORD = re.compile(r"[^\W_]+(?:[’'\-][^\W_]+)*")
CLOSERS = "”“»\"')]」』）〕】"
SKIPPED = "“„«「『\"*¿¡"
NUMBER = re.compile(r"[\d., \xa0]*\d\Z")
DEVANAGARI = re.compile(r"[ऀ-ॿ]")
SOUTHEAST_RUN = re.compile(r"[฀-\u0eff]+")
CJK_RUN = re.compile(rf"[{CJK}ー]+")
CAPITAL = re.compile(r"[A-ZÀ-ÖØ-Þ]")
SMALL = re.compile(r"[a-z]")
KNOWN = NEVER | BEFORE_NUMBER | EITHER
MARKS = {'"', *PAIRS, *PAIRS.values(), *QUOTES, *QUOTES.values()}


def _pairs(marks: Iterator[re.Match]) -> dict[int, int]:
    """Position of each bracket and quote that is opened to the position of its partner."""
    found: dict[int, int] = {}
    stack: list[tuple[str, int]] = []
    for m in marks:
        c, p = m[0], m.start()
        if stack and any(c == x for x, _ in stack):
            while stack:
                x, q = stack.pop()
                if x == c:
                    found[q] = p
                    break
        elif c in PAIRS:
            stack.append((PAIRS[c], p))
        elif c in QUOTES:
            stack.append((QUOTES[c], p))
        elif c == '"':
            stack.append(('"', p))
    return found


def _southeast(c: str) -> bool:
    return "\u0e00" <= c <= "\u0eff"


class _Block:
    def __init__(self, text: str, start: int, end: int, lexicon: Lexicon) -> None:
        self.text, self.end, self.lexicon = text, end, lexicon
        token = TOKEN if SPACELESS.search(text, start, end) else ANY_SPACED_TOKEN if OTHER_SCRIPTS.search(text, start, end) else SPACED_TOKEN
        self.tokens = token.finditer(text, start, end)
        self.pairs = _pairs(PAIRED.finditer(text, start, end))
        self.caseless = not CAPITAL.search(text, start, end) and bool(SMALL.search(text, start, end))

    def skip(self, p: int) -> int:
        text, end = self.text, self.end
        while p < end and text[p].isspace():
            p += 1
        return p

    def after(self, p: int) -> int:
        """The next character from ``p`` on that is neither space nor a bracketed remark nor a mark that opens a sentence."""
        text, end = self.text, self.end
        p = self.skip(p)
        while p < end:
            c = text[p]
            if c in PAIRS and p in self.pairs:
                p = self.skip(self.pairs[p] + 1)
            elif c in SKIPPED:
                p = self.skip(p + 1)
            else:
                break
        return p

    def before(self, p: int) -> int:
        p -= 1
        while p > 0 and self.text[p].isspace():
            p -= 1
        return p

    def full_stop(self, start: int, p: int) -> bool:
        """Whether the full stop at ``p`` ends a unit."""
        text, end = self.text, self.end
        if p + 1 >= end:
            return True
        c = text[p + 1]
        spaced = c.isspace()
        if not spaced and c not in CLOSERS and c not in PAIRS and c not in SKIPPED:
            # Glued to what follows: only a lost space between two words counts.
            if not c.isalpha() or c in "ºª°":
                return False
            a = max(text.rfind(".", start, p) + 1, start)
            last = WORD_BEFORE.search(text[max(a, text.rfind(" ", a, p) + 1) : p])[0].lower()
            return len(last) > 1 and not last[-1].isdigit() and last not in NEVER and (c.isupper() or self.caseless or not c.islower())
        a = max(text.rfind(" ", start, p), text.rfind("\n", start, p)) + 1 or start
        before = WORD_BEFORE.search(text[a:p])[0]
        word = before.lower().lstrip(".")
        tail = WORD.findall(word)[-1:] or [""]
        if not word:
            return p > start and (text[p - 1] in CLOSERS or text[p - 1].isspace() is False)
        at = self.after(p + 1)
        if at >= end:
            return True
        n = text[at]
        m = WORD.match(text, at, end)
        following = m[0].lower() if m else ""
        opened = self.skip(p + 1)
        marked = text[opened] in "“„«「¿¡([（〔" if opened < end else False
        if _southeast(text[p - 1]) or word.endswith("à-d"):
            return False
        last = re.split(r"[.'’]", word)[-1]
        if word in NEVER or last in NEVER and "." not in word:
            return False
        if word in EITHER or last in EITHER and "." not in word:
            if self.caseless:
                return following not in GOES_ON
            return not n.islower() or (marked and text[opened] in "“„«¿¡" and word in ("etc", "usw", "p.m"))
        if last in BEFORE_NUMBER and (n.isdigit() or n == "§"):
            return False
        if len(last) == 1 and last.isalpha() and not DEVANAGARI.match(last):
            # An initial, or the end of a sentence: "z. B." never is, "plan B. It" is.
            if a > start and text[max(start, a - 3) : a].lstrip(" \n")[-2:-1] == ".":
                return False
            return before[-1].isupper() and n.isupper() and following in STARTERS and text[m.end() : m.end() + 1] != "."
        if NUMBER.search(word):
            if following in AFTER_ORDINAL:
                return False
            if word.isdigit() and len(word) <= 2 and self._lists(start, p, word):
                return False
            return self.caseless or not n.islower()
        if n.islower() and not self.caseless and not marked:
            return len(tail[0]) > 2 and last not in BEFORE_NUMBER
        return True

    def _lists(self, start: int, p: int, number: str) -> bool:
        """Whether a number with a full stop counts the parts of a list within a sentence."""
        text = self.text
        at = p - len(number)
        if at > start + 1 and text[at - 1] in ".," and text[at - 2].isdigit():
            return False
        b = self.before(at)
        if b < start:
            return False
        if text[b] == ",":
            return True
        prior = text[max(text.rfind(" ", start, b + 1), text.rfind("\n", start, b + 1), start - 1) + 1 : b + 1].lower()
        if prior in LINKING:
            return True
        # "1. ..., 2. ...": the next number follows after a comma or a linking word, before the sentence can have ended twice.
        more = re.compile(rf"(?:,|\b(?:{'|'.join(LINKING)}))\s+{int(number) + 1}\.")
        found = more.search(text, p, self.end)
        return bool(found) and not re.search(rf"[{T}]", text[p : found.start()]) and len(re.findall(r"\w{4,}\.\s", text[p : found.start()])) == 0

    def starts(self, start: int, out: list[int]) -> None:
        text, end, pairs, caseless = self.text, self.end, self.pairs, self.caseless
        start = self.skip(start)
        skip_to = start
        for m in self.tokens:
            p = m.start()
            if p < skip_to:
                continue
            c = text[p]
            cut = -1
            if c == ".":
                if text.startswith(".", p + 1, end):
                    skip_to = p + 1
                    while skip_to < end and text[skip_to] == ".":
                        skip_to += 1
                    continue
                if p + 2 < end and text[p + 1] in " \n":
                    # The plain cases: a title; a small letter alone; and a word that is no abbreviation, before a capital.
                    raw, n = text[text.rfind(" ", start, p) + 1 or start : p], text[p + 2]
                    low = raw.lower()
                    if low in NEVER or (low in BEFORE_NUMBER and n.isdigit()) or (len(raw) == 1 and "a" <= raw <= "z"):
                        continue
                    if low not in KNOWN and len(low) > 2 and low.isalpha() and low[-1] < "ʰ" and (n.isupper() or caseless and n.isalnum()):
                        out.append(start)
                        start = skip_to = p + 2
                        continue
                if self.full_stop(start, p):
                    cut = p + 1
            elif c in PAIRS and p in pairs:
                skip_to = pairs[p] + 1
                nxt = self.skip(skip_to)
                if p == start:
                    # Nothing before it: a remark between sentences, unless the sentence visibly goes on.
                    if nxt >= end or self.caseless or not text[nxt].islower() and text[nxt] not in ",;:.":
                        cut = skip_to
                elif nxt < end and _southeast(text[nxt]) or _southeast(text[self.before(p)]):
                    if self.gap(start, self.before(p) + 1, nxt):
                        out.append(start)
                        start = p
                        cut = skip_to
            elif (c in QUOTES or c == '"') and p in pairs:
                q = pairs[p]
                skip_to = q + 1
                inner = text[self.before(q)]
                at = self.after(skip_to)
                if inner in ".。।॥" and at < end:
                    n = text[at]
                    if n not in ",;:.)!?，、。" and not ("ぁ" <= n <= "ん") and (self.caseless or not n.islower()):
                        cut = skip_to
                elif inner in "?!？！…" and at < end and text[at].isupper() and p == start and c in "„“«" and text[self.skip(skip_to)] in "“„«":
                    cut = skip_to
            elif c == "…":
                continue
            elif c in ASKING:
                q = p + 1
                while q < end and text[q] in "?!.":
                    q += 1
                at = self.skip(q)
                skip_to = q
                if at >= end or self.caseless or not text[at].islower() and text[at] not in ",;:":
                    cut = q
            elif c in FINAL_MARKS:
                q = p + 1
                while q < end and text[q] in FINAL_MARKS:
                    q += 1
                cut = skip_to = q
            elif c == "|":
                if p > start and DEVANAGARI.match(text[self.before(p)]):
                    cut = p + 1
            elif c.isspace():
                if self.gap(start, p, m.end()):
                    cut = m.end()
            elif c >= "ぁ" and c not in MARKS and self.joint(start, m.end()):
                cut = m.end()
            if cut >= 0:
                while cut < end and text[cut] in CLOSERS and cut not in pairs:
                    cut += 1
                out.append(start)
                start = self.skip(cut)
                skip_to = max(skip_to, start)
        if start < end:
            out.append(start)

    def _path(self, left: int, right: int, script: str) -> list[str]:
        return self.lexicon.lattice(self.text[left:right], script)

    def _last_words(self, start: int, left: int, script: str) -> list[str]:
        """The lattice words of the spaceless run that ends at ``left``."""
        text, a = self.text, left
        inside = _southeast if script != "cjk" else CJK_RUN.match
        while a > start and inside(text[a - 1]):
            a -= 1
        return self._path(a, left, script) if a < left else [""]

    def _next_words(self, right: int, run: re.Pattern, script: str) -> list[str]:
        m = run.match(self.text, right, self.end)
        return self._path(right, m.end(), script) if m else [""]

    def gap(self, start: int, left: int, right: int) -> bool:
        """Whether a unit ends in the gap between ``left`` and ``right``, where no terminator stands."""
        text, end = self.text, self.end
        if right >= end:
            return False
        a, n = text[left - 1], text[right]
        if _southeast(a):
            if text.endswith(("ครับ", "ค่ะ"), start, left):
                return True  # no other word ends so
            script = "lao" if a >= "\u0e80" else "thai"
            words = self._last_words(start, left, script)
            if words[-1] in THAI_FINAL:
                return True
            if n in PAIRS and right in self.pairs:
                # Judged with what follows the remark, when the remark is reached.
                return False
            counted = len(words) == 1 and text[self.before(left - len(words[-1]))].isdigit()  # "87 items"
            if not counted and (words[-1] in SOUTHEAST_OPEN_END or "".join(words[-2:]) in SOUTHEAST_OPEN_END) or LEAD.match(text, start, left):
                return False
            if not _southeast(n):
                return (n.isupper() or n in "“«") and not THAI_QUOTING.intersection(words)
            if words[-1] in THAI_QUESTION or "".join(words[-2:]) in THAI_QUESTION:
                return True
            first = self._next_words(right, SOUTHEAST_RUN, script)
            if script == "lao":
                return first[0] in LAO_OPENING
            # Between two clauses a space is the terminator, unless the second goes on with the first.
            if "".join(first[:2]) in THAI_OPENING:
                return True
            return first[0] not in SOUTHEAST_GOES_ON and (len(first) > 1 or first[0] in THAI_OPENING) and "".join(first[:2]) not in SOUTHEAST_GOES_ON
        if n in PAIRS and right in self.pairs or a in ")]":
            # A remark inside a clause, or one that stood at its end.
            return False
        if _southeast(n):
            if LEAD.match(text, start, left) or text[start:left].rstrip().endswith("."):
                return False
            script = "lao" if n >= "\u0e80" else "thai"
            first = self._next_words(right, SOUTHEAST_RUN, script)
            return first[0] in (LAO_OPENING if script == "lao" else THAI_OPENING)
        if CJK_RUN.match(a):
            first = self._next_words(right, CJK_RUN, "cjk")
            if not first[0]:
                return False
            if text.endswith(JA_POLITE, start, left):
                return True
            opens = first[0] in JA_OPENING or len(first) > 1 and first[1] in JA_TOPIC
            if text.endswith(JA_PLAIN, start, left) and opens:
                return True
            if text.endswith(ZH_FINAL, start, left):
                return text[left - 1] in ZH_QUESTION or first[0] in ZH_OPENING
            return False
        return False

    def joint(self, start: int, at: int) -> bool:
        """Whether a unit ends after a polite ending or a particle at ``at``, where not even white space stands."""
        text = self.text
        b = at
        while b > start and CJK_RUN.match(text[b - 1]):
            b -= 1
        m = CJK_RUN.match(text, at, self.end)
        path = self._path(b, m.end(), "cjk")
        p = b
        for i, word in enumerate(path):
            if p == at:
                if text[at - 1] in ZH_QUESTION:
                    return True
                # After a polite ending what follows must be a word of its own; after a Chinese particle, an opening word.
                return word in ZH_OPENING if text[at - 1] == "了" else len(word) > 1 or i + 1 < len(path) and path[i + 1] in JA_TOPIC
            p += len(word)
        return False


def _is_heading(line: str) -> bool:
    """A line that ends in a colon and names a speaker, not the beginning of a sentence that was broken off."""
    head = line.strip().rstrip(":：").rstrip()
    if not head or any(head.count(a) != head.count(b) for a, b in PAIRS.items()):
        return False
    bare = re.sub(r"[(（\[].*?[)）\]]", " ", head)
    if re.search(r"[!?。！？।»”;]", bare) or re.search(r"\d", bare):
        return False
    # A long word with a full stop is the end of a sentence, unless it is a title.
    if any(m[1].lower() not in NEVER for m in re.finditer(r"([^\W\d]{4,})\.\s", bare)):
        return False
    words = bare.lower().split()
    return 0 < len(words) <= 6 and words[-1] not in SAYING and not PRONOUNS.intersection(words)


def unit_starts(text: str, lexicon: Lexicon | None = None) -> list[int]:
    """The 0-based positions, in code points, where the sentence units of ``text`` begin; none for a blank text."""
    lexicon = lexicon or _default_lexicon()
    out: list[int] = []
    p, n = 0, len(text)
    while p < n:
        m = BLANK.search(text, p)
        end = m.start() if m else n
        while m and end > p and text[end - 1].isspace():
            end -= 1
        at = SPACE.match(text, p).end()
        while at < end:
            m2 = NOTE.match(text, at, end) or AGENDA.match(text, at, end)
            if m2:
                stop = m2.end()
            else:
                stop = text.find("\n", at, end)
                stop = end if stop < 0 else stop
                if text[stop - 1] not in ":： \t" or text[at:stop].rstrip()[-1:] not in (":", "：") or not _is_heading(text[at:stop]):
                    break
            out.append(at)
            at = SPACE.match(text, stop).end()
        if at < end:
            found: list[int] = []
            _Block(text, at, end, lexicon).starts(at, found)
            # Stray marks without any letter or digit belong to what precedes them.
            for i, s in enumerate(found):
                e = found[i + 1] if i + 1 < len(found) else end
                if i == 0 or text[s].isalnum() or any(c.isalnum() for c in text[s:e]):
                    out.append(s)
        p = m.end() if m else n
    return out


@lru_cache(maxsize=1)
def _default_lexicon() -> Lexicon:
    return installed_lexicon()


def sentence_units(df: DataFrame, doc_id: str = "doc_id", text: str = "text", lexicon: Lexicon | None = None) -> DataFrame:
    """(doc_id, start_pos) of every sentence unit. NULL and blank texts have none; other columns are ignored.

    One pass over the texts without a shuffle; rows that repeat a document give their units again. Texts of any length
    are processed whole. ``lexicon``: the word lists, by default those of the installed Unicode library; a few megabytes
    that are sent to every task.
    """
    spark = df.sparkSession
    sent = spark.sparkContext.broadcast(lexicon or installed_lexicon(spark))

    def segment(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = sent.value
        for batch in batches:
            ids, positions = [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = unit_starts(text, words)
                positions += found
                ids += [i] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(positions, pa.int32())], ["doc_id", "start_pos"])

    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.filter("text IS NOT NULL").mapInArrow(segment, "doc_id long, start_pos int")
