"""Problem 7: template residue, filler, error pages and script notices.

Two positive-unlabelled naive Bayes models are learned by expectation-maximization. The first tells notices and
filler from ordinary passages: trusted are the passages of records that consist for the most part of known
messages. The second tells fields left unfilled from fields that a text speaks about, among the passages that
hold a field mark: a template's sentence is an ordinary sentence around the mark. Passages are scored, and a record
is excluded if a field was left in one of its sentences or if notices make up a third or more of its evidence.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from embedflow.runtime import spread

# Messages by which records are trusted to be an error page, a script notice or filler
TRUSTED = re.compile(
    # filler
    r"lorem ipsum|dolor sit amet|ここに.{0,8}(入ります|書く)|仮の文です|ダミーの文|内容は準備中|仮文|\(仮\)|サンプル文|テストテスト"
    r"|your (description|text) here|texte (viendra|provisoire)|description à venir|aquí irá el texto|hier steht|blindtext|lipsum|здесь (написать|будет)|testo segnaposto|voorbeeldtekst"
    # errors, refusals, outages, expiry
    r"|\b(40[0134]|50[0234]) (not found|forbidden|bad|internal|service|gateway|error|unauthorized)|\((40[34]|50[0234])\)|\b(404|403|50[0234]) (ページ|サービス|アクセス)"
    r"|page not found|access (is )?denied|too many requests|traceback|sqlstate|bad gateway|internal server error|service unavailable|session (has )?expired|under (maintenance|construction)|link (has expired|is no longer valid)|temporarily unavailable"
    r"|メンテナンス中|混み合って|期限切れ|見つかりません|エラーが発生|利用できません|しばらくしてから|アクセスの確認中です|ロボットでないこと|アクセスが拒否|権限がありません"
    r"|página no encontrada|acceso denegado|en mantenimiento|sesión (ha )?(caducado|expirado)|enlace (ya no|ha caducado)|error interno del servidor"
    r"|page (non trouvée|introuvable)|accès (refusé|interdit)|session a expiré|maintenance en cours|lien n'est plus valable|erreur interne du serveur"
    r"|seite nicht gefunden|zugriff verweigert|wartungsarbeiten|sitzung (ist )?abgelaufen|link ist (nicht mehr gültig|abgelaufen)|interner serverfehler"
    r"|страница не найдена|доступ запрещ|технические работы|перемещена или удалена|ссылка устарела|внутренняя ошибка сервера|сеанс истёк"
    r"|pagina non trovata|accesso negato|pagina niet gevonden|toegang geweigerd|페이지를 찾을 수 없|접근이 거부"
    # scripts and checks of the browser
    r"|(enable|turn on|aktivier\w*|activ\w*|requires?) .{0,12}javascript|javascript.{0,12}(無効|有効|disabled|required)|noscript|cookies?.{0,12}(script|スクリプト)|スクリプトが(動かない|無効)|jsをオン|scripts? (off|must|in your browser|may be blocked)|(scripts|les scripts)\b.{0,40}(vide|vacía|charger)"
    r"|verifying that you are human|vérification de votre navigateur|browser wird geprüft|без скриптов|(проверка|проверяем).{0,12}браузер|включите.{0,12}скрипт|abilita javascript|schakel javascript in|자바스크립트를"
)
# Words that stand for a value that a program didn't have, and marks for a blank to be filled
RAW = r"\[object object\]|(?<![a-z\d_`'\"「『])(?:null|none|undefined|nan|nil)(?![a-z\d_`'\"」』])"
BLANK = r"_{3,}|[○〇△▲●◯□■◆]{2,}|(?<![a-z])x{3,}(?![a-z])|\((?:未入力|要記入|空欄|記入)\)|[\[<(](?:blank|vide|offen|insert here|à compléter|hier einsetzen|completar|vacío|пусто|заполнить|tbd)[\])>]|(?<![a-z])(?:tbd|tba|n/a|n\.n\.)(?![a-z])"
FIELD = (
    r"\{\{\{?[^{}\n]{0,40}\}\}\}?|\{%[^%\n]{0,60}%\}|<%[^%\n]{0,60}%>|\$\{[^}\n]{0,40}\}|#\{[^}\n]{0,40}\}|\{[^{}\n]{0,30}\}|\[\[[^\]\n]{0,40}\]\]|<<[^<>\n]{0,40}>>"
    r"|@@[^@\n]{1,40}@@|\*\|[^|\n]{0,40}\|\*|__\w{1,30}?__|«[\w.]{1,30}»|%%?[\p{L}_]{2,30}%%?|%(?:\([\w.]{1,30}\))?[sd](?![a-z])|\$\d(?!\d)|\[[^\[\]\d\n]{1,30}\]|<[^<>\d\n/]{1,30}>"
)
#: A record is residue if notices make up so much of what could be told apart in it, beside its title
LEAST_SHARE = 1 / 3
#: The most characters of a line of page furniture, and the least share and number of records that hold it
FURNITURE, FURNITURE_SHARE, FURNITURE_RECORDS = 60, 1 / 4000, 5
#: The most characters of a short record
SHORT = 300
ENDS = frozenset("。！？!?.")
#: What a title doesn't end with: it may be a question
TITLE_ENDS = ENDS - frozenset("？?")
_mark = regex.compile(f"(?P<raw>{RAW})|(?P<blank>{BLANK})|(?P<field>{FIELD})")
# what every mark holds at least: most passages hold none of it, and this test is quick
_mark_like = re.compile(r"[{<_○〇△▲●◯□■◆%$@|«\[]|null|none|undefined|nan|nil|xxx|tbd|tba|n/a|n\.n|\((?:未入力|要記入|空欄|記入)")
# The letters told apart, by ranges
CJK, LETTERS = "\u3005-\u3007\u3040-\u30ff\u3400-\u9fff", "a-z\u00c0-\u024f\u0300-\u052f"
_code = re.compile(r"(?:(?<!\w)[a-z]{1,3}-)?\d[\d./:\-]*")
INLINE = frozenset(["b", "i", "em", "strong", "span"])
_tags = re.compile(r"&nbsp;?|&#160;|</?(?:h[1-6]|p|b|i|br|hr|div|span|center|strong|em|html|body|head|ul|li)\s*/?>")
_breaks = re.compile(rf" (?<=[{CJK}0-9] )(?=[{CJK}「])")
_spaced = re.compile(r"(?<!\S)(?:\S[^\S\n](?:[^\S\n]{2})?){4,}\S(?!\S)")  # letters set apart
_joint = re.compile(r"[^\S\n](?=\S)")
_words = re.compile(rf"\x01\w|[{LETTERS}]+|[{CJK}]+|\d+")
#: Features are counted and scored by their bucket of so many; those of marks and numbers come first
BUCKETS = 1 << 20
MARKS = {"\x01r": 0, "\x01b": 1, "\x01f": 2}
THREE_MARKS, FOUR_MARKS, NUMBER, FIRST_BUCKET = 3, 4, 5, 8
#: Texts are coded together up to so many characters
CHUNK = 1 << 18
_BASE, _MIX = 0x5851F42D4C957F2D, 0x9E3779B97F4A7C15


def _letters_apart(text: str) -> bool:
    """Whether five words of one character follow each other."""
    run = 0
    for w in text.split():
        run = run + 1 if len(w) == 1 else 0
        if run == 5:
            return True
    return False


def passages(text: str) -> list[str]:
    """The sentences and lines of a text in a plain form: compatibility forms, lower case, tags and spaces folded."""
    plain = unicodedata.normalize("NFKC", text).lower().replace("\x01", " ")
    if "<" in plain or "&" in plain:
        plain = _tags.sub(lambda m: "\n" if m.group()[0] == "<" and m.group().strip("</ >") not in INLINE else " ", plain)
    if _letters_apart(plain):
        plain = _spaced.sub(lambda m: _joint.sub("", m.group()), plain)
    plain = "\n".join([" ".join(line.split()) for line in plain.split("\n")])
    for end in "。！？!?":
        plain = plain.replace(end, end + "\n")
    plain = _breaks.sub("\n", plain.replace(". ", ".\n"))
    return [p for x in plain.split("\n") if (p := x.strip())]


def features(passage: str) -> list[str]:
    """Words, pairs of neighbouring Japanese characters, and the kinds of marks; numbers and codes are folded."""
    out: list[str] = []
    for w in _words.findall(_code.sub("0 ", _with_marks(passage))):
        if len(w) > 1 and w[0] >= "\u3005":
            out += map(str.__add__, w, w[1:])
        else:
            out.append("0" if w.isdigit() else w)
    return out


def _with_marks(passage: str) -> str:
    return _mark.sub(lambda m: "\x01" + m.lastgroup[0], passage) if _mark_like.search(passage) else passage


@lru_cache(maxsize=1)
def _classes() -> tuple[np.ndarray, np.ndarray]:
    """For each character of the basic plane (the last entry: any other): its kind (1 letter, 2 CJK, 3 digit) and whether it is part of a word."""
    kind, word = np.zeros(65_537, np.uint8), np.zeros(65_537, bool)
    for k, one in ((1, re.compile(f"[{LETTERS}]")), (2, re.compile(f"[{CJK}]")), (3, re.compile(r"\d"))):
        kind[[m.start() for m in one.finditer("".join(map(chr, range(65_536))))]] = k
    word[[m.start() for m in re.finditer(r"\w", "".join(map(chr, range(65_536))))]] = True
    return kind, word


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash's base and of its inverse, modulo 2^64."""
    with np.errstate(over="ignore"):
        return tuple(np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, b, np.uint64))]) for b in (_BASE, pow(_BASE, -1, 1 << 64)))


def _bucket(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((h * np.uint64(_MIX) >> np.uint64(34)) % np.uint64(BUCKETS - FIRST_BUCKET)).astype(np.int32) + FIRST_BUCKET


def coded(ps: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of the features of all passages, in their order, and the passage of each: features() for many passages at once."""
    text = "\n".join(map(_with_marks, ps)) + "\n"
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds, word = _classes()
    low = np.minimum(c, 65_536)
    kind = kinds[low]
    out = np.full(len(c), -1, np.int32)
    at = np.flatnonzero(c == 1)
    for name, n in MARKS.items():
        out[at[c[at + 1] == ord(name[1])]] = n
    kind[at + 1] = 0
    digits = np.flatnonzero(kind == 3)
    codes = (kind == 3) | (c == ord(".")) | (c == ord("/")) | (c == ord(":")) | (c == ord("-"))
    run = np.searchsorted(np.flatnonzero(codes[1:] & ~codes[:-1]) + 1, digits, side="right")
    out[digits[np.flatnonzero(np.diff(run, prepend=-1))]] = NUMBER
    letter = kind == 1
    starts, ends = (np.flatnonzero(np.diff(letter.view(np.int8), prepend=0, append=0) == d) for d in (1, -1))
    if len(starts):
        size = ends - starts
        part = (size <= 3) & (c[ends] == ord("-")) & (kind[np.minimum(ends + 1, len(c) - 1)] == 3) & ~word[low[starts - 1]]
        part &= (c[starts] < 128) & (c[ends - 1] < 128) & (c[(starts + ends - 1) // 2] < 128)
        starts, ends = starts[~part], ends[~part]
        up, down = _powers(1 << int(len(c)).bit_length())
        with np.errstate(over="ignore"):
            total = np.concatenate([[np.uint64(0)], np.cumsum(c * up[: len(c)])])
            out[starts] = _bucket((total[ends] - total[starts]) * down[starts])
    cjk = kind == 2
    after, before = np.append(cjk[1:], False), np.append(False, cjk[:-1])
    two, one = np.flatnonzero(cjk & after), np.flatnonzero(cjk & ~after & ~before)
    out[two] = _bucket(c[two].astype(np.uint64) << np.uint64(21) | c[two + 1])
    out[one] = _bucket(c[one].astype(np.uint64))
    found = np.flatnonzero(out >= 0)
    return out[found], np.searchsorted(np.flatnonzero(c == 10), found).astype(np.int32)


def bucket_of(feature: str) -> int:
    """The bucket of a single feature."""
    if feature in MARKS or feature == "0":
        return MARKS.get(feature, NUMBER)
    if feature[0] >= "\u3005" and len(feature) == 2:
        h = ord(feature[0]) << 21 | ord(feature[1])
    else:
        h = sum(ord(x) * pow(_BASE, i, 1 << 64) for i, x in enumerate(feature)) % (1 << 64)
    return int(_bucket(np.array([h], np.uint64))[0])


def near_marks(feats: np.ndarray, reach: int = 8) -> np.ndarray:
    """The buckets within reach of a mark, and how many marks there are; what a sentence says further away has no bearing on the mark."""
    at = np.flatnonzero(feats < len(MARKS))
    near = np.zeros(len(feats) + 2 * reach, bool)
    for shift in range(2 * reach + 1):
        near[at + shift] = True
    more = [THREE_MARKS] * (len(at) >= 3) + [FOUR_MARKS] * (len(at) >= 4)
    return np.append(feats[near[reach : reach + len(feats)]], more).astype(np.int32)


def folded(passage: str) -> str:
    return _code.sub("0", passage)


def _own_line(text: str) -> bool:
    """Whether the first passage is a line of its own."""
    head, _, rest = text.strip().partition("\n")
    return bool(rest) and len(passages(head)) == 1


def has_mark(passage: str) -> bool:
    return bool(_mark_like.search(passage)) and bool(_mark.search(passage))


@dataclass(frozen=True)
class Coded:
    """Passages of some records: whose each is, whether it is a record's first, and the buckets of its features."""

    passages: list[str]
    record: np.ndarray
    first: np.ndarray
    bucket: np.ndarray
    passage: np.ndarray

    @staticmethod
    def of(texts: list[str]) -> "Coded":
        found = [passages(t) for t in texts]
        sizes = np.array([len(f) for f in found], np.int64)
        flat = [p for f in found for p in f]
        record = np.repeat(np.arange(len(texts)), sizes)
        parts, start, size = [], 0, 0
        for k, p in enumerate(flat):  # hashes of a chunk at a time, to bound what they need
            size += len(p) + 1
            if size >= CHUNK or k == len(flat) - 1:
                bucket, passage = coded(flat[start : k + 1])
                parts.append((bucket, passage + np.int32(start)))
                start, size = k + 1, 0
        bucket, passage = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int32), np.zeros(0, np.int32))
        return Coded(flat, record, np.diff(record, prepend=-1) > 0, bucket, passage)

    def without(self, left_out: np.ndarray) -> "Coded":
        """The passages that aren't left out."""
        kept = np.flatnonzero(~left_out)
        number = (np.cumsum(~left_out) - 1).astype(np.int32)
        own = ~left_out[self.passage]
        record = self.record[kept]
        return Coded([self.passages[k] for k in kept.tolist()], record, np.diff(record, prepend=-1) > 0, self.bucket[own], number[self.passage[own]])

    def bounds(self) -> np.ndarray:
        """Where the features of each passage begin, and the end."""
        return np.searchsorted(self.passage, np.arange(len(self.passages) + 1))

    def marked(self) -> np.ndarray:
        """The passages with a mark, ascending."""
        return np.unique(self.passage[self.bucket < len(MARKS)])


@dataclass(frozen=True)
class ResidueModel:
    """Log-likelihood ratios by bucket: notice against ordinary, unfilled field against mention of one."""

    notice: np.ndarray
    field: np.ndarray
    field_prior: float
    furniture: frozenset[str] = frozenset()

    def judged(self, texts: list[str | None]) -> np.ndarray:
        """Whether each text is residue; texts are judged one by one, in chunks."""
        out = np.zeros(len(texts), bool)
        own, size = [], 0
        for i, t in enumerate(texts):
            if t is not None and t.strip():
                own.append(i)
                size += len(t)
            if own and (size >= CHUNK or i == len(texts) - 1):
                out[own] = self._judged([texts[k] for k in own])
                own, size = [], 0
        return out

    def is_residue(self, text: str | None) -> bool:
        return bool(self.judged([text])[0])

    def _judged(self, texts: list[str]) -> np.ndarray:
        """Characters of notices and of ordinary text (those of a passage of little evidence in part), and the highest field score, decide."""
        c = Coded.of(texts)
        n, value = len(c.passages), self.notice[c.bucket].astype(np.float64)
        many = np.bincount(c.passage, minlength=n)
        total, size = np.bincount(c.passage, value, n), np.array([len(p) for p in c.passages], np.float64)
        skipped = np.array([len(p) <= FURNITURE and folded(p) in self.furniture for p in c.passages], bool) if self.furniture else np.zeros(n, bool)
        at, run = c.bounds(), np.concatenate([[0.0], np.cumsum(value), [0.0]])
        field = np.full(len(texts), -99.0)
        heads = np.flatnonzero(c.first & ~skipped)
        more = np.bincount(c.record, minlength=len(texts)) > 1
        best = np.full(n, -99.0)
        full = heads[many[heads] > 0]
        if len(full):  # the highest sum from some feature to the end: a title may stand before the first message
            best[full] = run[at[full + 1]] - np.minimum.reduceat(run, np.stack([at[full], at[full + 1]], axis=1).ravel())[::2]
        late = best > np.maximum(total, 7.0)
        for k in np.flatnonzero(late).tolist():
            sums = run[at[k + 1]] - run[at[k] : at[k + 1]]
            j = int(np.flatnonzero(sums == sums.max())[-1])
            total[k], size[k] = best[k], size[k] * (many[k] - j) / many[k]
        for k in heads[~late[heads] & (total[heads] < 0) & more[c.record[heads]]].tolist():
            if c.passages[k][-1] not in TITLE_ENDS or _own_line(texts[c.record[k]]):
                total[k] = 0.0
        for k in c.marked().tolist():
            if not skipped[k]:
                score = self.field_prior + float(self.field[near_marks(c.bucket[at[k] : at[k + 1]])].sum())
                field[c.record[k]] = max(field[c.record[k]], score)
        total = total - 1
        notice = np.where((total > 0) & ~skipped, size * np.minimum(total / 8, 1), 0)
        ordinary = np.where((total <= 0) & ~skipped, size * np.minimum(-total / np.maximum(1.5 * many, 8), 1), 0)
        notice, ordinary = (np.bincount(c.record, x, len(texts)) for x in (notice, ordinary))
        return (field > 0) | ((notice > 3) & (notice >= LEAST_SHARE * (notice + ordinary)))


def _ratios(positive: np.ndarray, negative: np.ndarray, weight: float = 300.0, most: float = 5.0) -> np.ndarray:
    """Log ratios of the two classes' feature rates, each drawn towards the pooled rates with the weight given.

    Even smoothing would favour the smaller class for each rare feature, and so for each rare language.
    """
    pooled = (positive + negative + 1e-6) / (positive + negative + 1e-6).sum()
    rate = lambda c: (c + weight * pooled) / (c.sum() + weight)
    return (np.log(rate(positive)) - np.log(rate(negative))).clip(-most, most)


def _posterior(score: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(score, -30, 30)))


def furniture_like(line: str) -> bool:
    """Whether a line may be page furniture: short, without a full stop, a known message or a field mark."""
    return may_be_furniture(line) and not TRUSTED.search(line) and not has_mark(line)


def may_be_furniture(line: str) -> bool:
    return len(line) <= FURNITURE and line[-1] not in ENDS


def least_records(records: int) -> int:
    """How many records must hold a line of page furniture."""
    return max(FURNITURE_RECORDS, math.ceil(records * FURNITURE_SHARE))


def learn(texts: list[str], rounds: int = 5, min_count: int = 3, repeated: frozenset[str] | None = None) -> ResidueModel:
    """Fits both models on the given texts; without a trusted record nothing is ever found.

    repeated: the lines that enough records of the whole table hold; by default those of the given texts. Such a line
    is page furniture, and left out, unless a first fit finds it to be a notice: by its own score, or because most
    records that hold it beside other passages are residue. It is then fitted and scored as any other passage.
    """
    texts = list(dict.fromkeys(texts))
    c = Coded.of(texts)
    lines = {k: q for k, p in enumerate(c.passages) if len(p) <= 2 * FURNITURE and len(q := folded(p)) <= FURNITURE and (repeated is None or q in repeated)}
    owners = {(int(c.record[k]), q) for k, q in lines.items()}
    if repeated is None:
        counted = Counter(q for _, q in owners)
        repeated = frozenset(q for q, n in counted.items() if n >= least_records(len(texts)) and furniture_like(q))
    left_out = lambda furniture: np.fromiter((lines.get(k) in furniture for k in range(len(c.passages))), bool, len(c.passages))
    seen = np.fromiter((bool(TRUSTED.search(p)) for p in c.passages), bool, len(c.passages))

    def fit(furniture: frozenset[str]) -> tuple[ResidueModel, np.ndarray]:
        out = left_out(furniture)
        return _fit(c.without(out), seen[~out], furniture, len(texts), rounds, min_count)

    model, labels = fit(repeated)
    held: dict[str, list[float]] = {}
    for d, q in owners:
        if q in repeated and labels[d] == labels[d]:
            held.setdefault(q, []).append(labels[d])
    listed = sorted(repeated)
    score = np.zeros(len(listed))
    if listed:
        bucket, line = coded(listed)
        score = np.bincount(line, model.notice[bucket], len(listed))
    notices = {q for q, own in zip(listed, score.tolist()) if own > 1 or (q in held and sum(held[q]) > 0.5 * len(held[q]))}
    return fit(repeated - notices)[0] if notices else model


def _fit(c: Coded, seen: np.ndarray, furniture: frozenset[str], records: int, rounds: int, min_count: int) -> tuple[ResidueModel, np.ndarray]:
    """The models, and how surely each record consists of notices (NaN: nothing but furniture and a title)."""
    unknown, n = np.full(records, np.nan), len(c.passages)
    table = np.zeros(BUCKETS, np.float32)
    at, marked = c.bounds(), c.marked()
    near = [near_marks(c.bucket[at[k] : at[k + 1]]) for k in marked.tolist()]  # what stands around the marks of a passage
    near_bucket = np.concatenate(near) if near else np.zeros(0, np.int32)
    counts = np.bincount(c.bucket, minlength=BUCKETS) + np.bincount(near_bucket[near_bucket <= FOUR_MARKS], minlength=BUCKETS)
    kept = np.flatnonzero(counts >= min_count)
    if not len(kept):
        return ResidueModel(table, table, -99.0, furniture), unknown
    number = np.full(BUCKETS, -1, np.int32)
    number[kept] = np.arange(len(kept))
    known = number[c.bucket] >= 0
    rows, cols, v = c.passage[known], number[c.bucket[known]], len(kept)
    doc_of, size = c.record, np.array([len(p) for p in c.passages], np.float64)
    weigh = lambda w: np.bincount(cols, weights=w[rows], minlength=v)
    score = lambda r: np.bincount(rows, weights=r[cols], minlength=n)
    length = np.bincount(doc_of, weights=size, minlength=records)
    share = lambda w: np.bincount(doc_of, weights=w * size, minlength=records) / length.clip(1)
    spread_out = lambda values: _table(kept, values)

    body = seen | ~c.first | np.array([p[-1] in TITLE_ENDS for p in c.passages])  # else a title
    whole, trust = share(body.astype(float)).clip(1e-9), share((seen & body).astype(float))
    trusted = ((trust >= 0.6 * whole) & (trust > 0))[doc_of]
    sure_text = ((length >= 250) & (trust < 0.15))[doc_of]  # reliable negatives
    if not trusted.any():
        notice, labels = np.zeros(v), unknown
    else:
        p = trusted * body.astype(float)
        for _ in range(rounds):
            notice = _ratios(weigh(p), weigh(1 - p))
            # a passage is labelled by its record: what is quoted in ordinary texts stays ordinary
            p = _posterior(12 * (share(_posterior(score(notice).clip(-8, 8) - 2) * body) / whole - 0.6))[doc_of]
            p = np.where(trusted, 1.0, np.where(sure_text, 0.0, p))
            labels = unknown.copy()
            labels[doc_of[body]] = p[body]
            p = p * body

    if not len(marked):
        return ResidueModel(spread_out(notice), table, -99.0, furniture), labels
    plain = score(notice) < 0
    plain[marked] = False
    certain = np.bincount(doc_of[marked], minlength=records)[doc_of[marked]] >= 2
    ordinary = weigh(plain.astype(float))
    near_rows, near_cols = np.repeat(np.arange(len(near)), [len(x) for x in near]), number[near_bucket]
    near_rows, near_cols = near_rows[near_cols >= 0], near_cols[near_cols >= 0]
    weigh_near = lambda w: np.bincount(near_cols, weights=w[near_rows], minlength=v)
    is_mark = kept <= FOUR_MARKS
    q = np.where(certain, 0.95, 0.5)
    for _ in range(rounds):
        used, mention = weigh_near(q), weigh_near(1 - q)
        # a template's sentence draws its other words as ordinary sentences do
        field = _ratios(ordinary, mention)
        field[ordinary > 3 * mention] = field[ordinary > 3 * mention].clip(0)  # or a rare language would count as mention
        by_mark = np.log((used + 1) / (used.sum() + 1)) - np.log((mention + 1) / (mention.sum() + 1))
        field = np.where(is_mark, by_mark, field)
        rate = float(q.mean())
        prior = math.log(max(rate, 1e-3) / max(1 - rate, 1e-3))
        q = _posterior(np.bincount(near_rows, weights=field[near_cols], minlength=len(near)) + prior + np.where(certain, 2.0, 0.0))
    return ResidueModel(spread_out(notice), spread_out(field), prior, furniture), labels


def _table(at: np.ndarray, values: np.ndarray) -> np.ndarray:
    out = np.zeros(BUCKETS, np.float32)
    out[at] = values
    return out


def repeated_lines(texts: DataFrame, rows: int) -> frozenset[str]:
    """texts: (t), of `rows` rows. Lines that may be page furniture and that enough different texts hold, counted over all of them.

    At most so many lines come to the driver as an average record has, times 1 / FURNITURE_SHARE.
    """

    def lines(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [
                (q, h) for t, h in zip(b.column("t").to_pylist(), b.column("h").to_pylist())
                for q in {folded(p) for p in passages(t) if p[-1] not in ENDS and len(p) <= 2 * FURNITURE} if may_be_furniture(q)
            ]
            yield pa.RecordBatch.from_arrays([pa.array([q for q, _ in found], pa.string()), pa.array([h for _, h in found], pa.int64())], names=["line", "h"])

    own = spread(texts.select("t", F.xxhash64("t").alias("h")), "h").mapInArrow(lines, "line string, h long").distinct()
    found = own.groupBy("line").count().where(F.col("count") >= least_records(rows)).select("line").collect()
    return frozenset(r.line for r in found if furniture_like(r.line))


def fit_residue_model(documents: DataFrame, text_col: str = "text", sample_rows: int = 32_000, seed: int = 3) -> ResidueModel:
    """Learns from a Bernoulli sample of about sample_rows records, taken from all of the table; a documented bound.

    Three eighths are drawn from all records, five from the short ones (up to SHORT characters), which most notices
    are, so that notices of rarer languages are among them. Repeated lines are counted over all records.
    """
    kept = documents.select(F.col(f"`{text_col}`").alias("t")).where("t IS NOT NULL")
    short = F.length("t") <= SHORT
    rows, short_rows = kept.agg(F.count("*"), F.count_if(short)).first()
    share = lambda part, of: min(1.0, sample_rows * part / 8 / max(of, 1))
    picked = kept.sample(fraction=share(3, rows), seed=seed).union(kept.where(short).sample(fraction=share(5, short_rows), seed=seed + 1)).toArrow()
    return learn(picked["t"].to_pylist(), repeated=repeated_lines(kept, rows))


def with_residue(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = 32_000, model: ResidueModel | None = None) -> DataFrame:
    """(id, residue): for each record whether it is residue, judged over its whole text.

    Null, empty and blank texts and texts without a word aren't; null ids keep a row; copies are judged alike; an
    empty frame gives an empty one.
    """
    model = model or fit_residue_model(documents, text_col, sample_rows)
    box = documents.sparkSession.sparkContext.broadcast(model)

    def judge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = box.value.judged(b.column("t").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(found)], names=["id", "residue"])

    own = documents.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("t"))
    return spread(own, "id").mapInArrow(judge, "id long, residue boolean")
