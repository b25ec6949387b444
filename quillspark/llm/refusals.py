"""Refusals by templates made of parts: what is said, of which matter, by whom, in eight languages.

A template is a core (inability with a verb of answering, missing evidence with its source, not knowing, being beyond
scope) among parts that go with it (courtesy, source, matter, reason, asking back). A sentence is aligned with the
templates by the parts it holds and by what it shares with the prompt; little of it may be left over.
"""

from __future__ import annotations

import functools
import re

import ahocorasick

from quillspark.llm.looks import canonical

# Parts of refusals, each language in its own words. UNABLE needs a verb of ANSWER near it, LACK a SOURCE.
PARTS = {
    "zh": {
        "UNABLE": "无法|不能|没办法|没有办法|无从|难以|恕难|恕不|不便|不方便|不可以|未能|没法|不会|无权|不予|不宜|爱莫能助|不上来|不出来|不了|不做|不作|我拒绝",
        "ANSWER": "回答|作答|解答|答复|回复|答|确认|确定|判断|断定|得知|得出|知晓|提供|说明|给出|协助|帮助|帮|处理|满足|评论|评价|讨论|推断|推测|猜测|发表|透露|告知|告诉|查证|核实|回应|支持|执行|完成|给予|答案|结论|说|找到|看出",
        "LACK": "没有提到|没有提及|未提到|未提及|没提到|没提|未提供|没有提供|没有说明|未说明|没有交代|未交代|没交代|没有写|没写|未写|没有记载|未记载|没有描述|未描述|没有涉及|未涉及|没有谈到|没谈到|未谈到|找不到|没有找到|没找到|未找到|查不到|未查到|没有查到|看不出|只字未提|不包含|没有包含|未包含|没有任何|没有给出|未给出|没有关于|并无|不存在|没有出现|未出现|没有线索|不支持|没有答案|没有显示|未显示|没有足够|缺乏足够|缺少足够|不足以",
        "LACKING": "信息不足|信息不够|资料不足|资料不够|线索不足|线索不够|证据不足|依据不足|内容不足|不足以得出|不足以回答|不足以判断|没有相关|无相关|缺乏相关|缺少相关|信息有限|没有更多信息",
        "UNKNOWN": "不知道|不清楚|不太清楚|不确定|不太确定|不得而知|不了解|不晓得|不明白",
        "BEYOND": "超出|超过|不在",
        "SCOPE": "能力|范围|权限|职责|服务",
        "SOURCE": "原文|文中|文本|文章|片段|段落|资料|材料|内容|上下文|书中|给定|给出的|提供的|检索到的|检索结果|已知信息|现有|目前|当前|依据|根据|信息|这段|以上|上述|节选|引文|来源|参考|从中|里面|其中",
        "SELF": "我|本人|作为|一个|助手|人工智能|语言模型|模型|系统|机器人|这边|本系统",
        "COURTESY": "抱歉|非常|很抱歉|对不起|不好意思|很遗憾|遗憾|恐怕|请见谅|见谅|请谅解|谅解|请原谅|恕|你好|您好|谢谢|感谢|感谢你的提问|提问|已阅读|已查阅|看过了|好的|可惜|实在|暂时|暂且|真的|目前",
        "MATTER": "这个问题|该问题|此问题|这一问题|您的问题|你的问题|的问题|问题|相关|有关|关于|对于|对此|具体|情况|细节|答案|要求|请求|这类|此类|这件事|这点|这一点|这一|这方面|方面|时间|地点|人物|原因|事情|任何|意见|看法|请求|你的|您的|您|你|准确|明确|确切|足够|更多|线索|描述|记载|所以|因此|因而|故|但是|但|而|也|并|来|的|了|是|里|中|与|和|对|就|在|为|到|有|没有|无|都|还|又|只|这|该|此|其|能|会|做|个",
        "ASK": "请提供|请补充|请告诉我|请先|请换|换一种|换个|再试|再问|书名|章节|问法|说法|更多线索|更多信息|可以|否则|才能|先|告诉|建议|查阅|咨询|另行|重新",
    },
    "ja": {
        "UNABLE": "できません|できかねます|致しかねます|いたしかねます|しかねます|かねます|できない|ことはできません|控えます|控えさせて|差し控え|お断り|不可能です|難しいです|得られません",
        "ANSWER": "答え|回答|返答|判断|確認|特定|断定|提供|説明|お伝え|お手伝い|対応|お応え|応じ|推測|言及|コメント|支援|明言|お教え|断言",
        "LACK": "書かれていません|記されていません|記載されていません|記載がありません|記載がなく|記述がありません|記述がなく|記述が見つか|見つかりません|見当たりません|触れられていません|述べられていません|言及されていません|言及がありません|含まれていません|ありません|示されていません|明記されていません|載っていません|見つからない|出てきません|ないため",
        "LACKING": "情報が不足|情報不足|情報が足り|情報がありません|情報がない|情報が十分|手がかりが不足|手がかりがありません|十分な情報|根拠が不足",
        "UNKNOWN": "わかりません|分かりません|わかりかねます|分かりかねます|存じません|存じ上げません|わからない|分からない|不明です|定かではありません",
        "BEYOND": "範囲外|超えて|対象外",
        "SCOPE": "範囲外|能力|範囲|対象外|権限",
        "SOURCE": "本文|文章|この文|文中|原文|資料|抜粋|段落|テキスト|提供された|与えられた|情報|文脈|内容|記述|断片|手元|引用|物語|作中|からは|では",
        "SELF": "私|わたし|当方|アシスタント|言語モデル|として|AI|ai",
        "COURTESY": "申し訳ありません|申し訳ございません|申し訳ない|すみません|ごめんなさい|恐れ入ります|恐縮です|残念ながら|残念|あいにく|失礼|ですが|が、|ご質問|ありがとうございます",
        "MATTER": "その質問|この質問|質問|ご質問|について|に関する|ことは|こと|ため|ので|だけ|のみ|その|この|には|には|お|ご|を|は|が|に|の|と|も|で|まで|から|ことが|です|ます|具体的|詳細|誰|何|どこ|いつ|なぜ|点|件|答えは|理由|いたし|させていただき",
        "ASK": "ください|教えて|お知らせ|改めて|別の|言い換え|書名|章",
    },
    "ko": {
        "UNABLE": "수없습니다|수없어요|수없음|수없네요|어렵습니다|어려워요|불가능합니다|못합니다|않겠습니다|삼가겠습니다|드릴수없|드리기어렵|곤란합니다|힘듭니다|못하겠습니다",
        "ANSWER": "답변|답할|대답|답을|답해|확인|판단|알수|알려|말씀|제공|도와|도움|설명|확정|추측|언급|처리|특정|파악|단정|논평|찾을",
        "LACK": "나와있지않|나오지않|언급되지않|언급이없|언급되어있지않|언급하지않|언급을찾|찾을수없|없습니다|포함되어있지않|포함되지않|기술되지않|적혀있지않|드러나지않|밝히지않|밝혀지지않|설명되지않|명시되지않|명시되어있지않|쓰여있지않",
        "LACKING": "정보가부족|정보가없|정보가충분하지|충분한정보|단서가부족|근거가부족|내용이부족|자료가부족|정보부족",
        "UNKNOWN": "모르겠|모릅니다|알지못|불분명|확실하지않|알수없|잘몰라",
        "BEYOND": "벗어난|벗어나|밖의|밖입니다|넘어서",
        "SCOPE": "범위|능력|권한",
        "SOURCE": "본문|글에|글만|글|지문|문서|자료|제공된|주어진|내용|정보|발췌|문맥|단락|텍스트|원문|만으로|에서는|에는",
        "SELF": "저는|제가|나는|저로서|인공지능|언어모델|어시스턴트|도우미|으로서|로서",
        "COURTESY": "죄송합니다|죄송하지만|죄송|미안합니다|미안|유감스럽게도|유감이지만|안타깝게도|아쉽게도|아쉽지만|안녕하세요|감사합니다|질문감사",
        "MATTER": "그질문|이질문|해당질문|질문에|질문|대해|대한|관한|관해|관련|것은|것을|것|누가|누구|무엇|어디|언제|왜|구체적|이를|그|이|해당|요청|은|는|을|를|에|의|로|으로|대해서는|지|드릴|하기|부분",
        "ASK": "주세요|주시|다시|다른|알려주|제목|책",
    },
    "en": {
        "UNABLE": "i cannot|i cant|i can not|i am unable|im unable|i am not able|im not able|i could not|i couldnt|i wont|i will not|i would rather not|i would prefer not|id rather not|we cannot|we cant|we are unable|cannot be|cant be|can not be|it is not possible|its not possible|it is impossible|its impossible|not possible|unable to|not able to|i must decline|i have to decline|i decline|not in a position|there is no way|no way to|not something i can|i am not allowed|im not allowed|i do not feel able|impossible to|doesnt allow|does not allow|doesnt let|i am afraid i cant|hard to say",
        "ANSWER": "answer|answered|say|tell|respond|reply|determine|determined|confirm|confirmed|provide|help|assist|comment|know|known|verify|verified|established|establish|inferred|infer|conclude|concluded|discuss|share|do that|guess|speculate|identify|identified|fulfil|fulfill|comply|decide|decided|resolve|give|offer|speak|address",
        "LACK": "does not mention|doesnt mention|do not mention|dont mention|did not mention|no mention|not mentioned|does not say|doesnt say|do not say|dont say|does not state|doesnt state|do not state|dont state|not stated|does not specify|doesnt specify|do not specify|not specified|does not tell|doesnt tell|do not tell|does not contain|doesnt contain|do not contain|dont contain|does not include|doesnt include|do not include|does not provide|doesnt provide|do not provide|dont provide|not provided|does not give|doesnt give|do not give|does not describe|doesnt describe|do not describe|not described|does not reveal|doesnt reveal|do not reveal|does not explain|doesnt explain|do not explain|does not address|doesnt address|do not address|does not cover|doesnt cover|do not cover|does not indicate|doesnt indicate|do not indicate|cannot find|cant find|could not find|couldnt find|did not find|didnt find|not found|no reference|no indication|no evidence|no details|nothing about|nothing in|nothing on|silent on|isnt in|is not in|arent in|isnt given|is not given|isnt covered|is not covered|says nothing|say nothing|nowhere|i do not see|i dont see|do not have|dont have|does not have|doesnt have|lacks|lack|without more|is missing|are missing|is absent|leaves open|unclear from",
        "LACKING": "not enough information|insufficient information|insufficient context|insufficient evidence|not enough context|not enough evidence|enough context|enough information|sufficient information|sufficient context|not enough detail|no information|no relevant information|too little information|lack of information|more information is needed|insufficient",
        "UNKNOWN": "i do not know|i dont know|i am not sure|im not sure|i have no idea|no idea|i am not certain|im not certain|i am unsure|im unsure|not known to me|is unknown|i do not have that information|i dont have that information|i do not have access|i dont have access|i have no information|i have no knowledge|unclear to me|beats me",
        "BEYOND": "beyond|outside|out of|exceeds",
        "SCOPE": "scope|abilities|ability|capabilities|capability|what i can|my knowledge|my role|my remit",
        "SOURCE": "text|passage|passages|context|excerpt|excerpts|document|documents|source|sources|material|materials|provided|given|information|paragraph|paragraphs|book|chapter|story|available|above|here|snippets|snippet|quoted|retrieved|answer|details",
        "SELF": "i|im|as an|as a|assistant|ai|language model|model|we|me|my",
        "COURTESY": "sorry|i am sorry|im sorry|apologies|i apologize|i apologise|my apologies|unfortunately|regrettably|i regret|i am afraid|im afraid|hello|hi|thanks|thank you|thank you for asking|for asking|great question|good question|please|excuse me|pardon|let me think|with regret|regret|i checked|i have read|i looked",
        "MATTER": "this|that|the|question|questions|your|to|on|for|of|about|it|in|from|be|by|with|any|such|based|what|who|when|where|why|how|whether|there|is|are|and|so|but|or|because|since|therefore|was|were|has|have|not|no|request|requests|kind|matter|subject|topic|those|these|at|which|a|an|am|did|do|does|can|could|would|will|here|some|specific|exact|certainty|reliably|confidently|only|alone|at all|just|came|happened|simply|right|now|current|currently|regarding|concerning|relevant|if|isnt|enough|myself|own|details|point|reason|you|as|asked|asking|them|they|anything|something|more|need|asks|stated|said|further|make|claim|out|find|",
        "ASK": "could you|can you|please provide|rephrase|clarify|share more|try again|another|provide more|more details|specify|let me know",
    },
    "de": {
        "UNABLE": "kann ich nicht|kann ich leider nicht|ich kann|kann nicht|nicht möglich|unmöglich|bin nicht in der lage|nicht in der lage|ist nicht zu|lässt sich nicht|lässt sich leider nicht|lässt sich|möchte ich nicht|darf ich nicht|ich darf|ich werde nicht|keine möglichkeit|vermag ich nicht|außerstande|nicht imstande|muss ich ablehnen|kann das nicht|kann dazu|kann hierzu|können wir nicht|dazu kann ich|kann man nicht",
        "ANSWER": "beantworten|antworten|antwort|auskunft|sagen|bestimmen|feststellen|bestätigen|helfen|weiterhelfen|beurteilen|entscheiden|äußern|angeben|geben|ermitteln|entnehmen|herausfinden|nennen|mitteilen|erfüllen|kommentieren|klären|ableiten|erkennen|beitragen",
        "LACK": "dazu nichts|darüber nichts|hierzu nichts|davon nichts|nichts davon|erwähnt nicht|nicht erwähnt|keine erwähnung|steht nicht|steht nichts|sagt nichts|sagen nichts|nichts über|nichts dazu|nicht genannt|nicht angegeben|nicht enthalten|enthält nicht|enthält keine|enthalten keine|nicht beschrieben|keine angaben|keine hinweise|kein hinweis|keine information|nicht hervor|nicht zu entnehmen|finde ich nicht|finde ich keine|nicht gefunden|gibt keine|geben keine|fehlen|fehlt|nicht zu finden|nennt nicht|nennt keine|bleibt offen|verrät nicht|finden sich keine|findet sich nichts|macht keine angaben|liefern keine|liefert keine",
        "LACKING": "nicht genügend informationen|nicht genug informationen|nicht ausreichend|unzureichend|zu wenig informationen|zu wenige informationen|keine ausreichenden|genügend informationen|reichen nicht|reicht nicht",
        "UNKNOWN": "weiß ich nicht|ich weiß es nicht|ich weiß nicht|keine ahnung|bin mir nicht sicher|bin nicht sicher|ist mir nicht bekannt|mir unbekannt|ist unklar|ist mir unklar|liegt mir nicht vor|liegen mir nicht vor|liegen mir keine",
        "BEYOND": "übersteigt|außerhalb|jenseits",
        "SCOPE": "möglichkeiten|fähigkeiten|rahmen|zuständigkeit|wissens|kenntnisse|bereichs",
        "SOURCE": "text|textstelle|textstellen|abschnitt|abschnitte|auszug|auszüge|auszügen|quelle|quellen|kontext|material|passage|passagen|vorliegenden|gegebenen|informationen|angaben|buch|kapitel|dokument|unterlagen|stelle|stellen|daraus|darüber|bereitgestellten|textauszug|textausschnitt|ausschnitt",
        "SELF": "ich|wir|mir|als|assistent|ki|sprachmodell|modell",
        "COURTESY": "es tut mir leid|tut mir leid|leider|entschuldigung|entschuldigen sie|verzeihung|bedaure|ich bedaure|bedauerlicherweise|hallo|danke|danke für die frage|bedauere",
        "MATTER": "diese|dieser|diesem|dieses|frage|das|die|der|den|dem|aber|dazu|darauf|hierzu|auf|zu|in|im|aus|es|ist|und|wer|was|wo|wann|warum|wie|ob|nicht|keine|ihre|deine|von|für|sich|deshalb|daher|also|nur|allein|anhand|anfrage|bitte|eine|ein|einer|genauen|genaue|sie|ihnen|dir|da|so|mit|über|um|zur|zum|dass|wird|werden|kann|an|solche|solchen|am|darin",
        "ASK": "bitte geben|genauer|andere|nochmal|formulieren|titel",
    },
    "fr": {
        "UNABLE": "je ne peux pas|je ne peux|je ne puis|je ne suis pas en mesure|pas en mesure|je ne saurais|il est impossible|impossible de|impossible|il nest pas possible|pas possible|je suis incapable|incapable de|je ne suis pas capable|je ne veux pas|je dois refuser|je refuse|on ne peut pas|nous ne pouvons pas|ne permet pas|ne permettent pas|je préfère ne pas|je ne pourrai pas|je ne pourrais pas|je ne suis pas autorisé",
        "ANSWER": "répondre|réponse|dire|déterminer|confirmer|aider|fournir|préciser|indiquer|donner|savoir|juger|commenter|affirmer|établir|identifier|me prononcer|prononcer|satisfaire|vérifier|conclure|traiter|renseigner|deviner",
        "LACK": "ne mentionne pas|ne mentionnent pas|nest pas mentionné|pas mentionné|aucune mention|ne dit pas|ne disent pas|ne dit rien|ne disent rien|ne précise pas|ne précisent pas|nest pas précisé|pas précisé|nindique pas|nindiquent pas|pas indiqué|ne contient pas|ne contiennent pas|ne parle pas|ne parlent pas|ne figure pas|ne fournit pas|ne fournissent pas|ne donne pas|ne donnent pas|aucune information|aucune indication|aucun détail|aucun élément|rien sur|je ne trouve pas|je ne trouve|nai pas trouvé|je ne vois pas|introuvable|nest pas décrit|nest pas dit|napparaît pas|ne révèle pas|aucune trace|ny a pas",
        "LACKING": "pas assez dinformations|pas suffisamment dinformations|informations insuffisantes|information insuffisante|insuffisant|insuffisants|assez déléments|pas assez déléments|manque dinformations|suffisamment dinformations|assez dinformations|trop peu dinformations",
        "UNKNOWN": "je ne sais pas|je lignore|jignore|je nen sais rien|aucune idée|je ne suis pas sûr|pas certain|je ne connais pas|je nai pas cette information|je nai pas la réponse|je ne dispose pas|je nai pas accès|est inconnu",
        "BEYOND": "dépasse|hors de|audelà de|au delà de|en dehors",
        "SCOPE": "capacités|compétences|portée|cadre|connaissances|compétence",
        "SOURCE": "texte|textes|passage|passages|extrait|extraits|contexte|document|documents|source|sources|fourni|fournis|fournies|donné|donnés|informations|livre|chapitre|disponible|disponibles|cidessus|récit",
        "SELF": "je|nous|moi|en tant que|tant|assistant|ia|modèle|langage",
        "COURTESY": "désolé|je suis désolé|désolée|pardon|excusezmoi|malheureusement|je regrette|regrette|hélas|bonjour|merci|toutes mes excuses|mes excuses|merci pour votre question|navré",
        "MATTER": "cette|ce|cet|ces|question|à|la|le|les|de|des|du|dans|sur|et|mais|donc|pour|qui|que|quoi|où|quand|pourquoi|comment|pas|est|en|un|une|votre|demande|il|elle|se|y|ne|ni|car|par|au|aux|si|cela|ça|avec|a|partir|seul|seuls|trouve|point|vous|lui|rien|plus|on|dont|cest|lon",
        "ASK": "pourriezvous|pouvezvous|veuillez|reformuler|préciser votre|davantage|titre",
    },
    "es": {
        "UNABLE": "no puedo|no podemos|no podría|no me es posible|no es posible|imposible|no soy capaz|soy incapaz|incapaz de|no estoy en condiciones|no se puede|no permite|no permiten|prefiero no|debo declinar|no voy a|me niego|no estoy autorizado|no estoy autorizada|no logro|no alcanzo",
        "ANSWER": "responder|respuesta|contestar|decir|determinar|confirmar|ayudar|ayudarte|ayudarle|proporcionar|precisar|indicar|dar|saber|juzgar|comentar|afirmar|identificar|opinar|verificar|concluir|deducir|atender|cumplir|facilitar|establecer|adivinar|responderla|averiguar",
        "LACK": "no menciona|no mencionan|no se menciona|no hay mención|ninguna mención|no dice|no dicen|no se dice|no especifica|no se especifica|no especifican|no indica|no indican|no se indica|no contiene|no contienen|no habla|no hablan|no figura|no aparece|no proporciona|no proporcionan|no ofrece|no ofrecen|no da|no dan|no incluye|no incluyen|no explica|no describe|no revela|ninguna información|no hay información|no hay datos|no hay detalles|nada sobre|no encuentro|no he encontrado|no encontré|no consta|no aclara|sin mención",
        "LACKING": "suficiente información|información suficiente|información insuficiente|insuficiente|insuficientes|falta información|faltan datos|datos suficientes|suficientes datos|poca información",
        "UNKNOWN": "no lo sé|no sé|desconozco|lo ignoro|no tengo idea|ni idea|no estoy seguro|no estoy segura|no conozco|no tengo esa información|no dispongo|no tengo acceso|se desconoce|no lo tengo claro",
        "BEYOND": "excede|fuera de|más allá|supera",
        "SCOPE": "capacidades|alcance|competencias|conocimientos|posibilidades|ámbito",
        "SOURCE": "texto|textos|pasaje|pasajes|fragmento|fragmentos|contexto|documento|documentos|fuente|fuentes|proporcionado|proporcionados|dado|dados|información|libro|capítulo|disponible|disponibles|extracto|extractos|relato",
        "SELF": "yo|como|asistente|ia|modelo|lenguaje|nosotros|me|mi",
        "COURTESY": "lo siento|perdón|perdona|disculpa|disculpe|disculpas|lamentablemente|desafortunadamente|por desgracia|lamento|hola|gracias|mil disculpas|mis disculpas|gracias por preguntar|me temo",
        "MATTER": "esta|este|esa|eso|ese|esto|pregunta|a|la|el|los|las|de|del|en|sobre|y|pero|por|para|que|quién|qué|dónde|cuándo|cómo|porqué|no|es|un|una|su|tu|solicitud|se|ni|con|al|lo|le|te|si|tal|partir|solo|más|hay|tengo|nada|mi|así|ello|ninguna|ningún|tiene|sea",
        "ASK": "podrías|podría|puedes|reformular|reformula|indique|título",
    },
    "pt": {
        "UNABLE": "não posso|não podemos|não consigo|não conseguimos|não me é possível|não é possível|impossível|sou incapaz|incapaz de|não sou capaz|não estou em condições|não se pode|não permite|não permitem|prefiro não|devo recusar|não vou|não poderia|não estou autorizado|não há como|não dá para",
        "ANSWER": "responder|resposta|dizer|determinar|confirmar|ajudar|ajudálo|fornecer|precisar|indicar|dar|saber|julgar|comentar|afirmar|identificar|opinar|verificar|concluir|deduzir|atender|cumprir|informar|estabelecer|adivinhar|esclarecer|apurar",
        "LACK": "não menciona|não mencionam|não é mencionado|não há menção|nenhuma menção|não diz|não dizem|não especifica|não especificam|não indica|não indicam|não contém|não contêm|não fala|não falam|não consta|não aparece|não fornece|não fornecem|não oferece|não oferecem|não dá|não dão|não inclui|não incluem|não explica|não descreve|não revela|nenhuma informação|não há informações|não há informação|não há dados|não há detalhes|nada sobre|não encontro|não encontrei|não esclarece|não traz|não trazem|sem menção",
        "LACKING": "informações suficientes|informação suficiente|informações insuficientes|informação insuficiente|insuficiente|insuficientes|faltam informações|falta informação|dados suficientes|poucas informações",
        "UNKNOWN": "não sei|desconheço|ignoro|não faço ideia|não tenho ideia|não tenho certeza|não tenho a certeza|não conheço|não tenho essa informação|não disponho|não tenho acesso|desconhecese|não estou certo",
        "BEYOND": "excede|fora do|fora de|além|ultrapassa",
        "SCOPE": "capacidades|alcance|competências|conhecimentos|possibilidades|âmbito|escopo",
        "SOURCE": "texto|textos|passagem|passagens|trecho|trechos|contexto|documento|documentos|fonte|fontes|fornecido|fornecidos|dado|dados|informação|informações|livro|capítulo|disponível|disponíveis|excerto|excertos|relato",
        "SELF": "eu|como|assistente|ia|modelo|linguagem|nós|me",
        "COURTESY": "desculpe|desculpa|sinto muito|lamento|infelizmente|perdão|peço desculpa|peço desculpas|olá|obrigado|obrigada|lamentavelmente|obrigado pela pergunta|receio",
        "MATTER": "esta|este|essa|isso|esse|isto|pergunta|a|o|os|as|de|do|da|dos|das|em|no|na|sobre|e|mas|por|para|que|quem|qual|onde|quando|como|porquê|não|é|um|uma|sua|seu|pedido|se|nem|com|ao|à|lhe|te|tal|partir|só|apenas|mais|há|tenho|nada|nesse|neste|nenhuma|nenhum|nos|tem|seja",
        "ASK": "poderia|pode reformular|reformule|indique|título",
    },
}
# Traditional characters of the Chinese parts, each followed by its simplified form.
TRADITIONAL = "無无 沒没 辦办 難难 復复 復复 確确 認认 斷断 協协 幫帮 處处 評评 論论 測测 發发 訴诉 實实 應应 說说 見见 給给 結结 來来 從从 關关 於于 問问 題题 請请 資资 訊讯 線线 據据 證证 這这 個个 為为 對对 與与 書书 節节 條条 內内 級级 檢检 還还 則则 權权 範范 圍围 務务 助助 語语 統统 機机 員员 試试 換换 種种 您您 暫暂 時时 間间 點点 細细 類类 並并 會会 過过 現现 當当 參参 開开 將将 裡里 裏里 僅仅 麼么 讓让 絕绝"
# Beginnings of a concession, behind which the answer follows.
CONCESSIONS = ("虽然", "尽管", "虽说", "although ", "though ", "even though ", "obwohl ", "bien que ", "aunque ", "embora ", "비록")
# What turns a core into the tale of something past, which is no refusal.
PAST = ("ませんでした", "なかった", "수없었", "못했", "몰랐")
SPEECH = ("“”", "「」", "『』", "«»")
REFUSED = 1 / 6  # share of a response's letters from which a refusal that comes after other matter makes it one
LEFT, LEFT_OVER = 6, 0.34  # letters that may be left over in a refusing sentence, and their share of a long one
NEAR = 40  # letters between inability and the verb of answering, lack and source
CORES = ("UNABLE", "LACK", "LACKING", "UNKNOWN", "BEYOND")
_SENTENCE = re.compile(r"[^。.!?\n]+[。.!?\n]*")
_WORD = re.compile(r"[^\W_]+")
_SIMPLE = str.maketrans({x[0]: x[1] for x in TRADITIONAL.split()})
SPACED = {"en", "de", "fr", "es", "pt"}


def form(sentence: str) -> str:
    """Words in lower case between single blanks, without signs; simplified characters; no blanks between Eastern letters."""
    words = " ".join(_WORD.findall(re.sub(r"(?<=\w)['’\-](?=\w)", "", sentence.lower()))).translate(_SIMPLE)
    return " " + re.sub(r"(?<=[^\x00-ʯ]) (?=[^\x00-ʯ])", "", words) + " "


@functools.cache
def _automaton(cores: bool = False) -> ahocorasick.Automaton:
    """All parts, or the cores alone; those of languages with blanks are whole words, Eastern ones stand anywhere."""
    held: dict[str, list[tuple[str, str]]] = {}
    for lang, kinds in PARTS.items():
        for kind, text in kinds.items():
            if cores and kind not in CORES:
                continue
            for part in filter(None, text.split("|")):
                keys = [f" {canonical(part).lower()} "] if lang in SPACED else [re.sub(r"[\W_]+", "", canonical(part).lower())]
                if lang == "fr" and kind in ("SOURCE", "MATTER", "ANSWER"):  # words behind an elided article or pronoun
                    keys += [f" {e}{part} " for e in ("l", "d", "qu", "s", "j")]
                for key in keys:
                    held.setdefault(key, []).append((lang, kind))
    tree = ahocorasick.Automaton()
    for key, what in held.items():
        tree.add_word(key, (len(key), what))
    tree.make_automaton()
    return tree


def _hits(s: str) -> dict[str, dict[str, list[tuple[int, int]]]]:
    """Of each language and kind the spans of its parts in a sentence's form."""
    out: dict[str, dict[str, list[tuple[int, int]]]] = {}
    for last, (n, what) in _automaton().iter(s):
        for lang, kind in what:
            blank = lang in SPACED
            out.setdefault(lang, {}).setdefault(kind, []).append((last - n + 1 + blank, last + 1 - blank))
    return out


def _near(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Those of ``a`` with one of ``b`` beside them that does not overlap."""
    return [x for x in a if any(y[0] - x[1] <= NEAR and x[0] - y[1] <= NEAR and (y[0] >= x[1] or x[0] >= y[1]) for y in b)]


class Refusals:
    """Aligns the sentences of a response with the templates."""

    def found(self, response: str, prompt: str) -> bool:
        """Whether a response (canonical) refuses: its first sentence that says anything does, or enough of it does."""
        if next(_automaton(True).iter(form(response)), None) is None:  # no sentence can have a core
            return False
        spans = [(m.start(), form(m.group())) for m in _SENTENCE.finditer(response)]
        spans = [(at, s) for at, s in spans if s.strip()]
        if not spans:
            return False
        asked = form(prompt)
        quoted_whole = response.strip()[:1] in "\"“「『«"
        total = refused = 0
        opened = False
        for i, (at, s) in enumerate(spans):
            size = len(s.replace(" ", ""))
            total += size
            own = self.sentence(s, asked) or i + 1 < len(spans) and size < 8 and self.sentence(s.rstrip() + spans[i + 1][1], asked)
            if own and (not _quoted(response, at) or quoted_whole and i == 0 and len(spans) == 1):
                refused += size
                if not opened:
                    return True
            opened = opened or not own and not self.courtesy(s)
        return refused > 0 and refused >= REFUSED * total

    def courtesy(self, s: str) -> bool:
        """Whether a sentence says nothing but courtesies and that one has looked."""
        return any("COURTESY" in kinds and self._left(s, [x for v in kinds.values() for x in v], "", lang) <= LEFT for lang, kinds in _hits(s).items())

    def sentence(self, s: str, asked: str) -> bool:
        """Whether a sentence holds the core of a template and little that belongs to neither its parts nor the prompt."""
        if s.strip().startswith(CONCESSIONS):
            return False
        for lang, kinds in _hits(s).items():
            cores = _near(kinds.get("UNABLE", []), kinds.get("ANSWER", [])) + _near(kinds.get("LACK", []), kinds.get("SOURCE", [])) + kinds.get("LACKING", []) + kinds.get("UNKNOWN", []) + _near(kinds.get("BEYOND", []), kinds.get("SCOPE", []))
            if not cores or any(p in s.replace(" ", "") for p in PAST):
                continue
            cores = [c for c in cores if not _told(s, c, asked, kinds, lang)]
            size = len(s.replace(" ", ""))
            if cores and self._left(s, [x for v in kinds.values() for x in v], asked, lang) <= max(LEFT, LEFT_OVER * size):
                return True
        return False

    @staticmethod
    def _left(s: str, spans: list[tuple[int, int]], asked: str, lang: str) -> int:
        """Letters that neither a part nor the prompt accounts for."""
        covered = bytearray(len(s))
        for a, b in spans:
            covered[a:b] = b"\x01" * (b - a)
        if lang in SPACED:
            for m in re.finditer(r"\S+", s):
                if f" {m.group()} " in asked or len(m.group()) > 3 and m.group() in asked:
                    covered[m.start() : m.end()] = b"\x01" * (m.end() - m.start())
        else:
            for i in range(len(s) - 1):
                if s[i : i + 2] in asked:
                    covered[i : i + 2] = b"\x01\x01"
        return sum(1 for c, done in zip(s, covered) if not done and c != " ")


def _told(s: str, core: tuple[int, int], asked: str, kinds: dict, lang: str) -> bool:
    """Whether someone in the story is the one who cannot or does not know: by a pronoun, a short name from the prompt, the form of the verb."""
    if lang == "ja":  # before a noun it describes that
        return s[: core[1]].endswith("ない") and not s[core[1] :].startswith((" ", "ため", "ので", "です", "から"))
    if lang == "ko":
        return s[core[1] :].startswith(("는", "던", "은"))
    if lang in SPACED:
        return False
    head = s[: core[0]].strip()
    for part in ("也", "还是", "还", "并", "都", "却", "仍", "始终", "当时", "根本", "实在"):
        head = head.removesuffix(part)
    if head.endswith(("他", "她", "他们", "她们")):
        return True
    if not head or any(b == len(head) + 1 for k in ("SELF", "SOURCE", "COURTESY", "MATTER") for _, b in kinds.get(k, []) if b - _ > 1):
        return False
    return 0 < len(head) <= 6 and head in asked and not any(x in head for x in "我这该此")


def _quoted(text: str, at: int) -> bool:
    """Whether the first letter of ``text`` from ``at`` stands inside a quotation."""
    while at < len(text) and not text[at].isalnum():
        at += 1
    head = text[:at]
    return head.count('"') % 2 == 1 or any(head.count(open_) > head.count(close) for open_, close in SPEECH)
