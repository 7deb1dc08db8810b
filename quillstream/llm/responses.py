"""Broken prompt and response pairs, each with its first defect (problem 4).

Defects in order: empty, copy, refusal, other_language, truncated. Copies are found by the containment of the output's
letter shingles in the prompt and the longest common subsequence; refusals by the same two measures against refusal
templates, sentence by sentence. The templates are made of the usual words of declining a request in ten languages, so
they are no list of known sentences. The language is judged by the hyperdimensional profiles. Whether an output stops
within a sentence is seen from its end. Every row is judged by itself, in one pass.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstream.llm.hdlang import Profiles, hangul, plain, segments
from quillstream.llm.strings import common_subsequence, letters, shingles

# Placeholders, as letters.
PLACEHOLDERS = {
    "없음", "na", "null", "none", "nil", "nan", "undefined", "endoftext", "empty", "blank", "todo", "tbd", "noanswer", "nooutput",
    "nocontent", "noresponse", "내용없음", "해당없음", "답변없음", "응답없음", "빈칸", "なし", "該当なし", "無し", "回答なし", "空", "无", "無", "eos", "pad",
    "s", "placeholder", "output", "insertcaptionhere",
}
# Words of declining, per language: what is not done, how it is declined, and signs that the speaker is the one
# asked. A template is a deed and a declining word in the language's order, or a phrase that declines by itself.
KO_DEEDS = "도와드리 도와드릴 도움을드리 들어드리 들어드릴 제공해드릴 제공할 제공하기 답변하기 답변드리 답변할 답변해드릴 대답하기 대답할 응답하 응답할 응할 작성하기 작성할 작성해드릴 써드릴 만들어드리 만들어드릴 생성할 처리할 수행할 진행할 협조하기 말씀드리기 안내해드릴 다루기 다룰".split()
KO_DECLINED = "수없 수가없 어렵 어려울 힘들 곤란 않겠 않도록 않습 못합 불가 아니 아닙".split()
KO_ALONE = "답변을드릴수없 요청을거절 응답을거부 정책에위배 정책상불가".split()
EN_DECLINED = ["can't", "cannot", "can not", "could not", "won't", "will not", "won't be able to", "unable to", "not able to", "rather not", "refuse to", "decline to", "not going to", "not allowed to", "not permitted to", "not comfortable"]
EN_DEEDS = "help assist write create produce provide answer fulfill fulfil comply generate respond complete discuss share offer support do_that do_this writing creating providing helping".split()
EN_ALONE = ["not something I can", "must decline", "have to decline", "need to decline", "against my guidelines", "against my policy", "against my policies", "violates my guidelines", "beyond what I can"]
JA_DEEDS = "お手伝い お答え お応え 回答 作成 提供 対応 生成 ご案内 協力 お受け 執筆 応じること お書き".split()
JA_DECLINED = "できません できかねます できない いたしかねます 致しかねます 控えさせて 差し控え 控えます できかね".split()
JA_ALONE = "応じられません 応えられません 答えられません お断り 書けません 作れません お引き受けできません".split()
ZH_DECLINED, ZH_DEEDS = "无法 不能 不便 没法 没办法 無法 拒绝".split(), "提供 回答 帮助 帮忙 协助 完成 撰写 生成 满足 处理 回应 编写 创作 写".split()
ROMANCE = {
    "es": (["no puedo", "no podré", "no me es posible", "no soy capaz de", "prefiero no", "me niego a"], "ayudar escribir proporcionar crear responder cumplir generar asistir ofrecer redactar".split(), ["debo negarme", "va en contra de mis"]),
    "pt": (["não posso", "não consigo", "não poderei", "não sou capaz de", "prefiro não"], "ajudar escrever fornecer criar responder cumprir gerar atender oferecer redigir".split(), ["devo recusar", "vai contra as minhas"]),
    "fr": (["je ne peux pas", "je ne pourrai pas", "je ne suis pas en mesure de", "je préfère ne pas", "je refuse de"], "aider écrire fournir créer répondre générer rédiger assister proposer".split(), ["je dois refuser", "contraire à mes"]),
    "id": (["tidak bisa", "tidak dapat", "tidak mampu", "lebih baik tidak"], "membantu menulis memberikan membuat menjawab memenuhi menghasilkan menyediakan".split(), ["harus menolak", "melanggar pedoman"]),
    "ru": (["не могу", "не смогу", "не буду", "не в состоянии"], "помочь написать предоставить создать ответить выполнить сгенерировать".split(), ["вынужден отказать", "вынуждена отказать", "противоречит моим"]),
}
DE_DEEDS = "helfen schreiben erstellen bereitstellen beantworten erfüllen generieren antworten liefern".split()
DE_DECLINED = ["kann ich nicht", "kann ich leider nicht", "ich kann nicht", "ich kann leider nicht", "kann dabei nicht", "ich kann Ihnen", "ich kann dir", "möchte ich nicht", "bin nicht in der Lage"]
ASKED_ONE = re.compile(
    r"죄송|안타깝|유감|양해|요청|부탁|저는|제가|제 |인공지능|언어 ?모델|해당|그 내용|이 내용|\bI\b|\bI['’]|\bmy\b|sorry|unfortunately|apolog|request|\bAI\b|language model|"
    r"申し訳|すみません|恐れ入|恐縮|ご依頼|ご要望|ご質問|リクエスト|その内容|いただ|抱歉|对不起|對不起|作为|我|lo siento|lamento|solicitud|petición|desculp|lamento|pedido|"
    r"désolé|regrette|demande|malheureusement|leider|entschuldig|Anfrage|tut mir|maaf|permintaan|saya|извин|сожален|запрос|прошу прощения|\bя\b", re.I)


# Turns of speech with declining words that decline nothing.
IDIOM = re.compile(r"\b(?:can['’]?t|cannot|couldn['’]?t|could not) help (?:but\b|(?:\w+sel(?:f|ves) )?(?:from )?\w+ing\b)|(?:웃|울|놀라|반하|사랑하|그러|인정하)지 않을 수(?:가)? 없|어쩔 수(?:가)? 없|なくてはいられ|ずにはいられ|わけにはいかない|不能不|不得不", re.I)


def refusal_templates() -> list[str]:
    """All templates; * stands for a few letters."""
    out = [f"{a}*{b}" for a in KO_DEEDS for b in KO_DECLINED] + KO_ALONE
    out += [f"{b}*{a.replace('_', ' ')}" for a in EN_DEEDS for b in EN_DECLINED] + EN_ALONE
    out += [f"{a}*{b}" for a in JA_DEEDS for b in JA_DECLINED] + JA_ALONE + [f"{b}*{a}" for a in ZH_DEEDS for b in ZH_DECLINED]
    for declined, deeds, alone in ROMANCE.values():
        out += [f"{b}*{a}" for a in deeds for b in declined] + alone
    return out + [f"{b}*{a}" for a in DE_DEEDS for b in DE_DECLINED]


# Names of languages in requests to answer in them.
ASKED = [
    (r"영어로|in English|英語で|en inglés|auf Englisch|en anglais", "en"), (r"한국어로|한글로|in Korean|韓国語で|用韩语", "ko"), (r"일본어로|in Japanese|日本語で", "ja"),
    (r"중국어로|in Chinese|中国語で|用中文", "zh"), (r"스페인어로|in Spanish|スペイン語で", "es"), (r"프랑스어로|in French|フランス語で", "fr"),
    (r"독일어로|in German|ドイツ語で", "de"), (r"러시아어로|in Russian|ロシア語で", "ru"), (r"포르투갈어로|in Portuguese|ポルトガル語で", "pt"),
    (r"인도네시아어로|in Indonesian|インドネシア語で", "id"),
]
_ASKED = [(re.compile(p, re.I), lang) for p, lang in ASKED]
CLOSING = ".!?。！？…~"
_TAIL = re.compile(r"(?:\s*#\S+|\s*https?://\S+|[\s\"'”’」』)\]`*_>]|[^\w\s.!?。！？…~,:;、，(\-—「『“‘/&+#@])+$")
_MARK = re.compile(r"[.!?。！？…~]")
SHINGLE, OWN_SHARE, OWN_LETTERS, LEAST_COPY = 6, 0.06, 2, 8
#: Share of a template's shingles and letters that align; letters between its two parts; share of an output that must decline
#: where its first two sentences don't.
SHINGLES_ALIGNED, LETTERS_ALIGNED, GAP, DECLINING = 0.75, 0.9, 12, 0.4


class Refusals:
    """Templates by their shingles, so that a sentence is aligned only with templates it shares most shingles with."""

    def __init__(self, templates: list[str]):
        self.whole = sorted({tuple(letters(p) for p in t.split("*")) for t in templates})
        self.grams = [set().union(*(shingles(p, self.size(p)) for p in t)) for t in self.whole]
        self.index: dict[str, list[int]] = {}
        for k, grams in enumerate(self.grams):
            for g in grams:
                self.index.setdefault(g, []).append(k)

    @staticmethod
    def size(piece: str) -> int:
        return min(3 if piece.isascii() else 2, len(piece))

    def aligned(self, sentence: str) -> bool:
        """Whether a template aligns with a stretch of the sentence's letters: most of its shingles, then nearly all letters."""
        hits: dict[int, list[int]] = {}
        for n in (1, 2, 3):
            for i in range(len(sentence) - n + 1):
                for k in self.index.get(sentence[i : i + n], ()):
                    hits.setdefault(k, []).append(i)
        for k, at in hits.items():
            if len(at) < SHINGLES_ALIGNED * len(self.grams[k]):
                continue
            one = "".join(self.whole[k])
            span = len(one) + GAP
            for a in sorted(set(at)):
                near = {sentence[i : i + n] for i in at if a <= i < a + span for n in (1, 2, 3)} & self.grams[k]
                if len(near) >= SHINGLES_ALIGNED * len(self.grams[k]) and common_subsequence(one, sentence[max(0, a - 1) : a + span]) >= LETTERS_ALIGNED * len(one):
                    return True
        return False

    def match(self, output: str) -> bool:
        """Whether the output declines: one of its first two sentences does, or sentences with a good share of its letters. A
        sentence declines if a template aligns with it and the speaker is the one asked, as it or a neighbour says."""
        output = IDIOM.sub(" ", output)
        if not ASKED_ONE.search(output):
            return False
        parts = [(x, letters(x)) for x in _SPLIT.split(output) if x and letters(x)]
        asked = [bool(ASKED_ONE.search(x)) for x, _ in parts]
        declining = [any(asked[max(0, i - 1) : i + 2]) and self.aligned(f) for i, (_, f) in enumerate(parts)]
        return any(declining[:2]) or sum(len(f) for (_, f), d in zip(parts, declining) if d) >= DECLINING * sum(len(f) for _, f in parts) > 0


_SPLIT = re.compile(r"(?<=[.!?。！？…])\s*|\n+")


_LABEL = re.compile(r"^[\s>\"'“*_-]*[^\W\d_]{1,12}(?: [^\W\d_]{1,12})?\s*[:：]\s*")


def is_copy(prompt: str, output: str) -> bool:
    """The output is the prompt or its scene, or part of it, with next to nothing of its own; a leading label is no own text."""
    p, o = letters(prompt), letters(output)
    if len(o) < LEAST_COPY or not p:
        return False
    if o not in p and len(bare := letters(_LABEL.sub("", output, count=1))) >= LEAST_COPY:
        o = bare
    own = len(o) - covered(o, shingles(p, SHINGLE), SHINGLE)
    if own > max(OWN_LETTERS, OWN_SHARE * len(o)):
        return False
    return common_subsequence(o, p) >= (1 - OWN_SHARE) * len(o) - OWN_LETTERS


def covered(s: str, grams: set[str], n: int) -> int:
    """Letters of s inside a shingle of the set."""
    total = upto = 0
    for i in range(len(s) - n + 1):
        if s[i : i + n] in grams:
            total += i + n - max(i, upto)
            upto = i + n
    return total


# Endings of Korean and Japanese sentences that go without a closing mark.
_ENDED = re.compile(r"(?:[가-힣]{2,}(?:습니다|니다|세요|어요|아요|해요|네요|군요|지요|죠)|[가-힣]+[갔겠났냈녔됐떴랐랬렀렸봤빴샀섰썼았었였왔웠졌챘첬쳤췄켰탔텼팠폈했혔]다|(?:です|ます|でした|ました|ません))$")


def stops_within(output: str) -> bool:
    """Whether a text stops within a sentence: no closing mark ends it (tags, links, quotes and emoji aside). A text without
    any closing mark may also end with a word that closes a sentence."""
    text = unicodedata.normalize("NFKC", output.replace("\u200b", "").replace("\u200d", "")).strip()
    text = _TAIL.sub("", text).rstrip()
    if not text or text[-1] in CLOSING:
        return False
    return bool(_MARK.search(text)) or not _ENDED.search(text)


def judge(df: DataFrame, profiles: Profiles, id_col: str = "response_id", prompt: str = "prompt", output: str = "output") -> DataFrame:
    """(response_id, defect): one row per defective id.

    Repeated rows count once; of several outputs of one id, the first defect in the order above is given. Null ids are
    left out; a null prompt is an empty one, a null output is empty. Other columns, clashing names included, are not read.
    """
    refusals = Refusals(refusal_templates())

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            n = len(pdf)
            prompts, outputs = [p or "" for p in pdf["p"]], [o or "" for o in pdf["o"]]
            defect: list[str | None] = [None] * n
            parts: list[str] = []
            spans: dict[int, tuple[int, int, int]] = {}
            for i in range(n):
                flat = plain(outputs[i])
                bare = letters(flat)
                if bare in PLACEHOLDERS or not bare and not any(unicodedata.category(c) == "So" for c in flat):
                    defect[i] = "empty"
                elif is_copy(prompts[i], outputs[i]):
                    defect[i] = "copy"
                elif refusals.match(flat):
                    defect[i] = "refusal"
                elif hangul(prompts[i]) and hangul(outputs[i]):  # one language has that script, so no profile need be asked
                    defect[i] = "truncated" if stops_within(outputs[i]) else None
                else:
                    a, b = segments(prompts[i]), segments(outputs[i])
                    spans[i] = (len(parts), len(parts) + len(a), len(parts) + len(a) + len(b))
                    parts += a + b
            langs, conf = profiles.classify(parts)
            for i, (x, y, z) in spans.items():
                said = _majority(parts, langs, conf, y, z)
                own = _majority(parts, langs, conf, x, y)
                if said and own and said != own and said not in {lang for pattern, lang in _ASKED if pattern.search(prompts[i])}:
                    defect[i] = "other_language"
                elif stops_within(outputs[i]):
                    defect[i] = "truncated"
            found = pd.DataFrame({"id": pdf["id"], "defect": pd.Series(defect, dtype=object)})
            yield found[found["defect"].notna()]

    rows = df.select(F.col(id_col).alias("id"), F.col(prompt).alias("p"), F.col(output).alias("o")).where("id is not null")
    order = F.create_map(*[x for k, v in enumerate(("empty", "copy", "refusal", "other_language", "truncated")) for x in (F.lit(v), F.lit(k))])
    found = rows.mapInPandas(look, f"id {dict(df.dtypes)[id_col]}, defect string")
    return found.groupBy("id").agg(F.min_by("defect", order[F.col("defect")]).alias("defect")).select(F.col("id").alias(id_col), "defect")


def _majority(parts: list[str], langs: list[str], conf, a: int, b: int) -> str | None:
    """The language of most letters of the sure segments a to b."""
    weight: dict[str, float] = {}
    for k in range(a, b):
        if conf[k] >= 0.7 and len(letters(parts[k])) >= 6:
            weight[langs[k]] = weight.get(langs[k], 0) + len(parts[k].encode())
    return max(weight, key=weight.get) if weight else None
