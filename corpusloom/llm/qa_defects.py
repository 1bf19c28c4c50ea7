"""Question-answer pairs whose answer does not serve the question.

Each pair gets at most one defect:

``empty``      nothing but white space, punctuation, a placeholder or an answer label
``refusal``    declines, or says that it cannot answer
``copy``       gives back nothing but the question
``language``   a full answer in another language than the question's, which the
               question does not ask for
``truncated``  breaks off

Shortened answers are found by sorting: all responses, and all their sentences with
the digits folded, are sorted by text, and each is compared with its neighbours.
A text that another one continues follows directly before it, and a text that
shares its opening with others stands beside the one it shares most with.  The sort
is by range; each task walks its own range, and the ends of ranges are compared
with the ends of the next ones.  Evidence is added up (``ENOUGH`` points make a
truncation):

* an unfinished last sentence that another text continues, or that shares
  ``MIN_OPENING`` characters with a neighbour, unless the same text also stands
  complete elsewhere (2 points);
* a response of several sentences that a longer response continues, also where it
  was cut at the end of a sentence (2 points);
* a length at which more answers end than at the lengths around it, most of them
  unfinished: a length limit (1 point);
* an ellipsis, or the bare number of a next item (2 points); a hanging comma, colon
  or dash, an unclosed bracket (1 point each).

Defined results: a null answer is empty; a null question takes part in no copy or
language rule; short answers without a final mark and lists are sound; repeated
pairs are judged each; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.session import materialise

# Placeholders for a missing answer, without punctuation and case.
PLACEHOLDERS = [
    "无", "暂无", "空", "没有", "无答案", "暂无答案", "未知", "待补充", "待定", "略", "na", "nan", "null", "nil", "none", "empty",
    "tbd", "todo", "unknown", "noanswer", "noanswerprovided", "なし", "該当なし", "없음", "нет", "ninguno", "ninguna", "aucun", "aucune", "keine", "nenhum",
]
# Labels before an answer.
LABELS = r"(?:答案|回答|答复|答|answer|ans|a|réponse|reponse|respuesta|resposta|antwort|回答|답변|답|ответ|response)"
ANSWER_WORDS = ["答", "回答", "答案", "answer", "ans", "respuesta", "resposta", "réponse", "antwort", "ответ", "답변", "response"]
_LABEL = rf"(?i)^\s*{LABELS}\s*[:：]\s*"
_QUESTION_LABEL = r"(?i)^\s*(?:您的问题是|你的问题是|您问的是|你问的是|问题|题目|提问|关于|问|the question is|your question is|question|q|frage|pregunta|pergunta|質問|질문|вопрос)\s*[:：]?\s*"

# Ways to decline, by script; matched in lower case.
_ZH_CANNOT = "(?:无法|不能|不便|未能|难以|没有办法|没办法|不予|恕不|拒绝)"
_ZH_ANSWER = "(?:回答|作答|答复|解答|给出|提供|判断|确定|得出|协助|帮助|回应)"
_ZH_SELF = "(?:我|助手|本系统|系统|本助手|本模型)"
_EN_CANNOT = "(?:can['’]?t|cannot|can not|could not|couldn['’]t|unable|not able|won['’]t)"
REFUSALS = {
    r"\p{IsHan}": [
        f"(?:抱歉|对不起|很遗憾|遗憾的是|不好意思).{{0,40}}(?:{_ZH_CANNOT}|超出)", "(?:问题|请求|要求).{0,4}超出.{0,12}(?:范围|能力|权限)",
        f"作为.{{0,12}}(?:语言模型|人工智能|ai|助手|机器人).{{0,20}}(?:{_ZH_CANNOT}|不)", f"^{_ZH_SELF}.{{0,6}}{_ZH_CANNOT}(?:对此)?{_ZH_ANSWER}", f"^{_ZH_SELF}.{{0,6}}{_ZH_CANNOT}对此",
        f"根据(?:现有|当前|所给|提供的|已有).{{0,16}}{_ZH_CANNOT}{_ZH_ANSWER}", f"(?:资料|上下文|检索内容|材料|信息)不足.{{0,12}}{_ZH_CANNOT}",
        f"(?:没有|未找到|未检索到|找不到|缺乏|缺少|未提供).{{0,6}}(?:信息|依据|内容|资料|证据|答案).{{0,12}}{_ZH_CANNOT}{_ZH_ANSWER}",
        "申し訳(?:ありません|ございません).{0,40}(?:できません|できかねます|お答え)", "(?:お答え|回答)(?:する)?(?:ことは|は|を)?(?:できません|できかねます|致しかねます|控え|差し控え)",
    ],
    r"\p{IsLatin}": [
        rf"\b(?:sorry|afraid|unfortunately|apologi[sz]e)\b.{{0,60}}\b(?:{_EN_CANNOT}|outside|beyond)", rf"\bas an? (?:ai |large )?(?:language model|assistant|ai)\b.{{0,60}}{_EN_CANNOT}",
        r"\bi (?:must |have to |need to )?(?:decline|refuse)\b", r"\bi(?:['’]m| am)? (?:can['’]?t|cannot|unable to|not able to|do not|don['’]t) (?:answer|help|know|determine|respond|provide|have)\b",
        r"\bdo(?:es)? not (?:contain|provide|include|have|give) (?:enough |sufficient |any |the )?(?:relevant )?(?:information|evidence|context|details)\b.{0,60}(?:answer|question|determin|given)",
        r"\bno answer can be given\b", r"\bquestion cannot be answered\b", r"\b(?:outside|beyond) (?:my|the scope of (?:this|the) (?:assistant|system))\b",
        r"\b(?:leider|entschuldigung|tut mir leid)\b.{0,50}\bnicht\b.{0,25}(?:beantworten|helfen|sagen|antworten)", r"\b(?:ich|sich)\b.{0,20}\b(?:das|dies|diese frage)\b.{0,8}\bnicht beantworten\b", r"\bkann ich diese frage nicht\b",
        r"\b(?:désolée?|je regrette|malheureusement)\b.{0,40}(?:ne peux|ne puis|impossible|ne suis pas)", r"\b(?:ne permet(?:tent)?|ne suffi(?:t|sent)) pas (?:de|d['’]|à|pour) ?(?:y )?répondre\b", r"\b(?:impossible|pas possible) (?:de|d['’]) ?(?:y )?répondre\b",
        r"\b(?:lo siento|lamentablemente|perdón)\b.{0,40}no (?:puedo|me es posible|dispongo)", r"\bno (?:permiten?|es posible|se puede) responder\b",
        r"\b(?:desculpe|sinto muito|lamento|infelizmente)\b.{0,40}não (?:posso|consigo)", r"\bnão (?:permitem?|é possível|se pode) responder\b",
    ],
    r"\p{IsCyrillic}": ["(?:извините|простите|к сожалению).{0,40}(?:не могу|не можем|невозможно)", "(?:невозможно|не позволяют|не позволяет) ответить"],
    r"\p{IsHangul}": ["(?:죄송|유감).{0,30}(?:없습니다|못합니다|어렵습니다)", "(?:답변|대답)(?:할 수|드릴 수|하기).{0,4}(?:없|어렵)"],
}

# Every pattern above needs one of these; looked for first, as a search for plain text is cheap.
REFUSAL_WORDS = [
    "无法", "不能", "不便", "未能", "难以", "没有办法", "没办法", "不予", "恕不", "拒绝", "超出", "作为", "申し訳", "できません", "かねます", "控え",
    "can't", "can’t", "cannot", "cant ", "can not", "could", "unable", "not able", "won't", "won’t", "outside", "beyond", "decline", "refuse", "i don", "do not", "does not", "no answer",
    "nicht", "ne peux", "ne puis", "ne suis", "imposs", "pas possible", "répondre", "no puedo", "no me es", "no dispongo", "responder", "não posso", "não consigo",
    "не могу", "не можем", "невозможно", "ответить", "없", "못합니다", "어렵",
]
# Frequent function words of the languages in Latin script.
FUNCTION_WORDS = {
    "en": "the of and to that is are for with on were this by from not how what which should their an be did does why about into as at it in an was a than has have been or but no",
    "de": "der die das und ist den dem nicht mit von für auf wie werden sich ein eine einer zu des im in über sind dass was bei oder auch nur zum zur",
    "fr": "le la les des et est dans que qui une un pour sur avec par pas du au aux ne se leur mais lorsque ce cette de en l d à",
    "es": "el la los las de y en que es del con para por una un se su no al como más pero sobre cómo qué lo",
    "pt": "o a os as de e em que do da dos das com para por uma um se não na no ao como mais mas sobre quando nas nos pelo pela",
}
# Names of languages in questions that ask for one.
ASKED = {
    "en": r"英文|英语|英語|\benglish\b|englisch|anglais|inglés|inglês|영어|английск",
    "zh": r"中文|汉语|漢語|中国語|\bchinese\b|chinesisch|chinois|\bchino\b|chinês|중국어|китайск",
    "ja": r"日文|日语|日語|日本語|\bjapanese\b|japanisch|japonais|japonés|japonês|일본어|японск",
    "ko": r"韩文|韩语|韓国語|한국어|\bkorean\b|koreanisch|coréen|coreano|корейск",
    "de": r"德文|德语|ドイツ語|\bgerman\b|auf deutsch|allemand|alemán|alemão|독일어|немецк",
    "fr": r"法文|法语|フランス語|\bfrench\b|französisch|français|francés|francês|프랑스어|французск",
    "es": r"西班牙文|西班牙语|スペイン語|\bspanish\b|spanisch|espagnol|español|espanhol|스페인어|испанск",
    "pt": r"葡萄牙文|葡萄牙语|ポルトガル語|\bportuguese\b|portugiesisch|portugais|portugués|português|포르투갈어|португальск",
    "ru": r"俄文|俄语|ロシア語|\brussian\b|russisch|russe\b|\bruso\b|\brusso\b|러시아어|на русском",
}

_END = r"[。．.!！?？｡]"
_CLOSERS = r"[”\"'’」』）)\]】》»›\s]"
_CLOSING = "”\"'’」』）)]】》»› \t\n\r。．.!！?？｡…\u3000\u00a0"
_NUMBERING = r"^\s*(?:[0-9]+\s*[.、)）]|[-*•·])\s*"
_ELLIPSIS = rf"(?:…|\.\.\.|。。。){_CLOSERS}*$"
_NEXT_ITEM = r"(?:^|[；;：:，,、\s])[0-9]+[.、)）]$"
_BRACKETS = (("（(", "）)"), ("【\\[", "】\\]"), ("《", "》"), ("“", "”"), ("「", "」"), ("«", "»"))
#: Characters a sentence shares with a neighbour where it is more than a term.
MIN_OPENING = 8
#: Points that make a truncation.
ENOUGH = 2
#: Standard deviations by which a length limit stands out, and the least share of unfinished answers there.
SPIKE_DEVIATIONS, SPIKE_SHARE = 6.0, 0.8
#: Share of its characters in which a repeated question may differ from the question.
COPY_EDITS = 0.1


def _bare(text: Column) -> Column:
    """Text without white space and punctuation, lower-cased."""
    return F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\p{P}\p{IsWhite_Space}\p{Cf}\p{Cc}]+", ""))


def _count(text: Column, char_class: str) -> Column:
    return F.length(F.regexp_replace(text, f"[^{char_class}]+", ""))


def with_language(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds the language of a text, null if unclear: by script, and by function words within Latin script.

    Latin letters count a fifth: one word against one character of the others."""
    t = F.coalesce(F.col(text), F.lit(""))
    foreign = ~t.rlike(r"^\p{ASCII}*+$")
    script = lambda chars: F.when(foreign, _count(t, chars)).otherwise(0)
    df = df.withColumns({"_east": script(r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}"), "_hangul": script(r"\p{IsHangul}"), "_cyrillic": script(r"\p{IsCyrillic}"), "_latin": _count(t, r"\p{IsLatin}") / 5})
    df = df.withColumn("_most", F.greatest("_east", "_hangul", "_cyrillic", "_latin"))
    df = df.withColumn("_kana", F.when((F.col("_most") > 0) & (F.col("_east") == F.col("_most")), _count(t, r"\p{IsHiragana}\p{IsKatakana}")))
    spaced = (F.col("_latin") > 0) & (F.col("_latin") == F.col("_most"))
    df = df.withColumn("_words", F.when(spaced, F.split(F.lower(t), r"[^\p{L}]+")))
    count = lambda words: F.size(F.filter("_words", lambda w: w.isin(*words.split())))
    hits = [F.struct(count(words).alias("n"), F.lit(lang).alias("lang")) for lang, words in FUNCTION_WORDS.items()]
    df = df.withColumn("_hits", F.when(spaced, F.reverse(F.array_sort(F.array(*hits)))))
    best, second = F.col("_hits")[0], F.col("_hits")[1]
    language = (
        F.when(F.col("_most") <= 0, None)
        .when(F.col("_east") == F.col("_most"), F.when(F.col("_kana") * 10 >= F.col("_east"), "ja").otherwise("zh"))
        .when(F.col("_hangul") == F.col("_most"), "ko").when(F.col("_cyrillic") == F.col("_most"), "ru")
        .when((best["n"] >= 2) & (best["n"] > second["n"]), best["lang"])
    )
    return df.withColumn(out, language).drop("_words", "_east", "_kana", "_hangul", "_cyrillic", "_latin", "_most", "_hits")


def is_refusal(lowered: Column) -> Column:
    """Whether a lower-cased text declines: the patterns of a script are only tried on texts that hold it and one of the words they need."""
    likely = reduce(lambda a, b: a | b, [lowered.contains(word) for word in REFUSAL_WORDS])
    return likely & reduce(lambda a, b: a | b, [lowered.rlike(script) & lowered.rlike("|".join(patterns)) for script, patterns in REFUSALS.items()])


def is_copy(asked: Column, told: Column, bare: Column, body: Column) -> Column:
    """Whether an answer is the question once or several times, with or without a label before it, or the question in hardly other words.

    ``asked``, ``told`` and ``bare`` are the question and the answer without and with a label, without white space and punctuation."""
    again = body.rlike(r"[?？][^\p{L}\p{N}]*$") & (F.levenshtein(told, asked, 20) >= 0) & (F.levenshtein(told, asked) <= COPY_EDITS * F.length(asked))
    return (asked != "") & ((F.replace(bare, asked, F.lit("")) == "") | (F.replace(told, asked, F.lit("")) == "") | again)


def _is_full(text: Column) -> Column:
    """Long enough to be a full answer: a sentence, not a term."""
    return (F.size(F.split(F.trim(text), r"\s+")) >= 5) | (_count(text, r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}") >= 10)


def _sentences(text: Column) -> Column:
    """Sentences and lines, each with its closing mark; a line break closes a line."""
    marked = F.regexp_replace(text, r"\s*\n\s*", "\ue000")
    pieces = F.split(marked, "(?<=[。！？!?｡])(?![”\"'’」』）)\\]】》»])|(?<=[。！？!?｡][”\"'’」』）)\\]】》»])|(?<=[^0-9][.])\\s+|(?<=\ue000)")
    return F.filter(F.transform(pieces, lambda p: F.regexp_replace(F.trim(p), _NUMBERING, "")), lambda p: (p != "") & (p != "\ue000"))


def _fold(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"[0-9]+(?:[.,][0-9]+)?", "#"), r"\s+", " ")


def _core(text: Column) -> Column:
    """A sentence without its closing marks."""
    return F.rtrim(text, F.lit(_CLOSING + "\ue000"))


_WALK = "text string, pid int, wanted boolean, opening int, longer boolean, edge boolean"


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over one range in rising order: what each text shares with its neighbours, and whether the next one continues it.

    The first and the last text of the range are given back as edges in any case."""
    before = None  # the text before: (text, pid, wanted, shared with its own predecessor)
    first = True
    for batch in batches:
        out = []
        for text, wanted, pid in zip(*(batch.column(c).to_pylist() for c in ("text", "wanted", "pid"))):
            shared = 0
            if before is not None:
                shared = len(commonprefix((before[0], text)))
                if before[2] or first:
                    out.append((before[0], before[1], before[2], max(before[3], shared), text.startswith(before[0]), first))
                first = False
                if shared == len(before[0]):  # a text that is over does not share an opening, it is continued
                    shared = 0
            before = (text, pid, wanted, shared)
        yield _walked(out)
    if before is not None:
        yield _walked([(*before, None, True)])


def _walked(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.string(), pa.int32(), pa.bool_(), pa.int32(), pa.bool_(), pa.bool_())
    columns = list(zip(*rows)) or [()] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["text", "pid", "wanted", "opening", "longer", "edge"])


def _shared(a: Column, b: Column) -> Column:
    """Length of the common prefix of two texts."""
    n = F.least(F.length(a), F.length(b))
    return F.when(n > 0, F.coalesce(F.array_min(F.filter(F.sequence(F.lit(1), n), lambda i: a.substr(i, F.lit(1)) != b.substr(i, F.lit(1)))) - 1, n)).otherwise(0)


def neighbours(texts: DataFrame) -> DataFrame:
    """``(text, opening, longer)`` of the wanted rows of distinct ``(text, wanted)``, compared with their neighbours in order:
    the characters shared with the closer one where it goes on otherwise or further, and whether one continues the text."""
    ranged = texts.repartitionByRange(F.col("text")).sortWithinPartitions("text").select("text", "wanted", F.spark_partition_id().alias("pid"))
    walked = materialise(ranged.mapInArrow(_walk, _WALK))
    # the ends of the ranges: two rows of each, so this window sees few rows
    order = Window.orderBy("pid", "text")
    ends = walked.filter("edge").withColumns({"prev": F.lag("text").over(order), "next": F.lead("text").over(order), "p_pid": F.lag("pid").over(order), "n_pid": F.lead("pid").over(order)})
    before = F.when((F.col("p_pid") != F.col("pid")) & (~F.col("text").startswith(F.col("prev"))), _shared(F.col("prev"), F.col("text")))
    after = F.when(F.col("n_pid") != F.col("pid"), _shared(F.col("text"), F.col("next")))
    settled = ends.filter("wanted").select("text", F.greatest("opening", F.coalesce(before, F.lit(0)), F.coalesce(after, F.lit(0))).alias("opening"), F.coalesce("longer", (F.col("n_pid") != F.col("pid")) & F.col("next").startswith(F.col("text")), F.lit(False)).alias("longer"))
    return walked.filter("wanted AND NOT edge").select("text", "opening", "longer").unionByName(settled)


def length_limits(lengths: DataFrame) -> DataFrame:
    """The ``len`` of ``(len, n, cut)`` at which answers pile up, most of them cut, against the five lengths on either side."""
    near = lengths.select(F.explode(F.sequence(F.col("len") - 5, F.col("len") + 5)).alias("len"), (F.col("len")).alias("of"), "n").filter("len <> of").groupBy("len").agg((F.sum("n") / 10).alias("around"))
    both = lengths.join(near, "len", "left").withColumn("around", F.coalesce("around", F.lit(0.0)))
    return both.filter((F.col("n") > F.col("around") + SPIKE_DEVIATIONS * F.sqrt(F.col("around") + 1)) & (F.col("cut") >= SPIKE_SHARE * F.col("n"))).select("len")


def _judged(pairs: DataFrame) -> DataFrame:
    """Every pair with its body and the first of the defects that its own text shows."""
    body = F.trim(F.regexp_replace(F.coalesce(F.col("answer"), F.lit("")), _LABEL, ""))
    rows = pairs.select("tab", "pair_id", "question", F.coalesce("answer", F.lit("")).alias("answer"), body.alias("body"))
    rows = rows.withColumns({"lowered": F.lower("answer"), "bare": _bare(F.col("body")), "whole": _bare(F.col("answer")), "asked": _bare(F.col("question")), "told": _bare(F.regexp_replace("body", _QUESTION_LABEL, ""))})
    empty = (F.col("bare") == "") | F.col("bare").isin(*PLACEHOLDERS) | F.col("whole").isin(*PLACEHOLDERS, *ANSWER_WORDS)
    copied = is_copy(F.col("asked"), F.col("told"), F.col("bare"), F.col("body"))
    rows = rows.withColumn("defect", F.when(empty, "empty").when(is_refusal(F.col("lowered")), "refusal").when(copied, "copy")).drop("lowered", "bare", "whole", "asked", "told")
    rows = with_language(with_language(rows, "question", "q_lang"), "body", "a_lang")
    lowered = F.lower("question")
    wanted = reduce(lambda a, b: a | b, [(F.col("a_lang") == lang) & lowered.rlike(names) for lang, names in ASKED.items()])
    other = (F.col("q_lang") != F.col("a_lang")) & _is_full(F.col("body"))
    rows = rows.withColumn("defect", F.coalesce("defect", F.when(F.coalesce(other, F.lit(False)), F.when(~wanted, "language"))))
    text = F.col("body")
    end = F.rtrim(text, F.lit(_CLOSING))  # the closing marks gone, so the patterns look at a few last characters
    end = F.concat(F.right(end, F.lit(8)), F.substr(text, F.length(end) + 1))
    ended = end.rlike(rf"(?:{_END}|[）)\]】》」』]){_CLOSERS}*$") & ~end.rlike(_ELLIPSIS) & ~end.rlike(_NEXT_ITEM)
    return rows.select("tab", "pair_id", "defect", "body", F.when(F.col("defect").isNull(), _sentences(text)).alias("sentences"), ended.alias("ended"))


def flag_defects(pairs: DataFrame) -> DataFrame:
    """``(tab, pair_id, defect)`` of the defective rows of ``(tab, pair_id, question, answer)``."""
    rows = materialise(_judged(pairs))
    sound = rows.filter("defect IS NULL AND body <> ''")
    # whole responses ("r") and all their sentences and lines ("s"); only unfinished last sentences and responses of several sentences are asked for
    n, text = F.size("sentences"), F.col("body")
    whole = F.concat(F.lit("r"), F.regexp_replace(text, r"\s+", " "))
    part = lambda s: F.concat(F.lit("s"), _fold(_core(s)))
    asks = F.col("s").rlike(r"[?？]\s*$")
    pieces = sound.select(F.posexplode("sentences").alias("pos", "s"), n.alias("n"), "ended").withColumn("tail", (F.col("pos") == F.col("n") - 1) & ~F.col("ended"))
    pieces = pieces.select(part(F.col("s")).alias("text"), (~F.col("tail") & ~asks).alias("complete"), F.col("tail").alias("wanted")).filter("complete OR wanted")
    responses = sound.select(whole.alias("text"), F.lit(False).alias("complete"), (n > 1).alias("wanted"))
    table = pieces.unionByName(responses).filter("length(text) > 1").groupBy("text").agg(F.max("complete").alias("complete"), F.max("wanted").alias("wanted"))
    table = materialise(table)
    # a text that also stands complete is finished
    found = neighbours(table.select("text", "wanted")).join(table.filter("complete AND wanted").select("text"), "text", "left_anti").filter((F.col("longer") & (F.length("text") > 4)) | (F.col("opening") > MIN_OPENING))
    found = materialise(found)
    limits = length_limits(sound.groupBy(F.length("body").alias("len")).agg(F.count("*").alias("n"), F.count_if(~F.col("ended")).alias("cut")))
    unclosed = reduce(lambda a, b: a | b, [_count(text, o) > _count(text, c) for o, c in _BRACKETS])
    signs = (
        2 * (text.rlike(_ELLIPSIS) | text.rlike(_NEXT_ITEM)).cast("int") + text.rlike(r"[，、；：，,;:（(\-—–“«「《/&+]\s*$").cast("int") + unclosed.cast("int")
    )
    points = lambda c: F.when(F.col(c).isNotNull(), 2).otherwise(0)
    weighed = (
        sound.select("tab", "pair_id", "ended", F.length("body").alias("len"), whole.alias("whole"), part(F.element_at("sentences", -1)).alias("last"), F.when(F.col("ended"), 0).otherwise(signs).alias("signs"), (n > 1).alias("several"))
        .join(found.select(F.col("text").alias("last"), F.lit(1).alias("tail_found")), "last", "left")
        .join(found.filter("longer AND text LIKE 'r%'").select(F.col("text").alias("whole"), F.lit(1).alias("whole_found")), "whole", "left")
        .join(limits.withColumn("limit", F.lit(1)), "len", "left")
        .withColumn("points", F.col("signs") + F.when(~F.col("ended"), points("tail_found") + F.coalesce("limit", F.lit(0))).otherwise(0) + F.when(F.col("several"), points("whole_found")).otherwise(0))
    )
    cut = weighed.filter(F.col("points") >= ENOUGH).select("tab", "pair_id", F.lit("truncated").alias("defect"))
    return rows.filter("defect IS NOT NULL").select("tab", "pair_id", "defect").unionByName(cut)
