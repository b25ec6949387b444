"""Refusals and answers written for this test, without the tables; none of them was used to write the parts."""

from quillspark.llm import defects
from quillspark.llm.looks import canonical
from quillspark.llm.refusals import Refusals, form

REFUSALS = {
    "钟楼是谁修的？": ["抱歉，资料里没有关于钟楼的内容。", "我没法确定是谁修的。", "对不起，这超出了我能回答的范围。", "片段中并未提及修钟楼的人。", "目前的信息不足以回答这个问题。", "这个我不太清楚，您可以换个问题。", "依据现有段落无法判断钟楼是谁修的。", "很抱歉，我不能提供这方面的信息。"],
    "Who built the clock tower?": ["I'm sorry, I don't know who built it.", "The excerpt does not mention the builder.", "There isn't enough information in the text to answer this.", "I can't help with that question.", "Based on the passage, it is not possible to determine who built the tower.", "Unfortunately I am unable to confirm this from the provided text.", "No information is given about that.", "I have no idea, sorry."],
    "時計塔は誰が建てましたか。": ["すみません、わかりません。", "抜粋には建てた人についての記述がありません。", "お答えできかねます。", "情報が足りないため判断できません。"],
    "시계탑은 누가 세웠습니까?": ["죄송합니다만 알려 드릴 수 없습니다.", "글에 언급되어 있지 않습니다.", "정보가 부족해서 답할 수 없습니다.", "모르겠습니다."],
    "Wer hat den Uhrturm gebaut?": ["Leider weiß ich das nicht, ich habe keine Ahnung.", "Das wird im Text nicht erwähnt.", "Es tut mir leid, dabei kann ich nicht helfen.", "Aus dem Abschnitt geht das nicht hervor."],
    "Qui a construit la tour ?": ["Je ne sais pas qui a construit la tour.", "Le passage ne mentionne pas cela.", "Désolé, je ne peux pas vous aider.", "Il est impossible de répondre avec ce texte."],
    "¿Quién construyó la torre?": ["No sé quién construyó la torre.", "El pasaje no lo menciona, no puedo responder.", "Lo siento, no puedo ayudarte con eso.", "No hay suficiente información en el texto."],
    "Quem construiu a torre?": ["Não sei quem construiu a torre.", "O texto não menciona isso.", "Desculpe, não posso ajudar com isso.", "Não é possível determinar com base no texto."],
}
ANSWERS = {
    "钟楼是谁修的？": ["是一个不愿留下名字的石匠。", "没有人知道，只有老会计记得那年冬天来过三个外乡人。", "石匠修好了钟楼，却没有提到报酬。", "他没能回答，转身上了钟楼。", "守夜人说钟楼是他父亲修的，可惜图纸找不到了。", "钟楼是岚婆婆请人修的。"],
    "Who built the clock tower?": ["A mason who would not give his name.", "The miller's brother, though he could not read the plans.", "Two sisters built it after the flood.", "He said he did not know the way to the tower.", "Old Harn, who never answered letters, built it.", "The keeper was not able to climb it, so his son did."],
    "時計塔は誰が建てましたか。": ["名を知られていない石工が建てました。", "祖父が建てたと番人は言いました。"],
    "시계탑은 누가 세웠습니까?": ["이름 없는 석공이 세웠습니다.", "마을 사람들이 함께 세웠습니다."],
    "Wer hat den Uhrturm gebaut?": ["Ein Maurer, den niemand kannte.", "Der Müller baute ihn, ohne etwas zu sagen."],
    "Qui a construit la tour ?": ["Un maçon qui ne savait pas lire.", "Le meunier et ses deux frères."],
    "¿Quién construyó la torre?": ["Un albañil que no sabía leer.", "La construyó el molinero."],
    "Quem construiu a torre?": ["Um pedreiro que não sabia ler.", "Foi o moleiro com os irmãos."],
}


def test_refusals_that_were_not_seen():
    judge = Refusals()
    said = lambda q, a: judge.found(canonical(a), canonical(q))
    flagged = [(a, said(q, a)) for q, own in REFUSALS.items() for a in own]
    wrong = [a for q, own in ANSWERS.items() for a in own if said(q, a)]
    right = sum(f for _, f in flagged)
    assert right / len(flagged) >= 0.9, [a for a, f in flagged if not f]
    assert right / (right + len(wrong)) >= 0.9, wrong


def test_refusals_behind_other_matter_and_in_speech():
    judge = Refusals()
    assert judge.found(canonical("Great question, thank you for asking. Let me think about it. I cannot answer this question."), "who came?")
    story = canonical("夏在盐仓找到了旧地图和一只信匣，把它们带回了灯塔。梅追问地图的来历，两人沿着海岸走了整整一夜。“我不知道。”他说。")
    assert not judge.found(story, "夏在盐仓找到了什么?")
    assert not judge.found("", "") and form("") .strip() == ""


def test_open_words_and_lead_ins():
    assert defects.breaks_off("Denniv came to the") and defects.breaks_off("夏把") and not defects.breaks_off("Corva") and not defects.breaks_off("第三层的天井")
    back = lambda q, a: defects.gives_back(q, a, Refusals())
    assert back("Who came to the harbour?", "As requested, who came to the harbour?") and back("Who?", "Who?") and back("谁来了?", "您想知道的是:谁来了?")
    assert not back("Who came?", "Corvath came. Who came?") and not back("谁来了?", "谁来了?船长来了。") and not back("谁来了?", "船长。")
