"""Answers that stand in none of the test tables: refusals, plain answers that sound alike, and languages outside the corpus."""

import pytest

from quern.llm import defects

REFUSALS = """
Sorry, but that's not something I can help with.
We are unable to provide this information.
I'm not able to answer questions about that subject.
I am afraid I cannot comment on ongoing investigations.
This request cannot be processed.
Your question was declined because it violates our terms.
I won't discuss this topic.
Thank you for asking. I can't share any details about this.
I have to refuse to answer that.
I’d rather not say anything about it. Please ask somebody else.
I don't have enough information to answer.
I do not have permission to view the file.
We regret that we cannot respond to this query.
It is not possible for me to give medical advice.
I will not write that for you.
No comment.
No information can be given at this stage.
As a language model I am not allowed to reveal such content.
Unfortunately, we're not in a position to disclose that.
Apologies, I must decline to reply.
I’m sorry. I can’t assist with that request.
Diese Anfrage wird abgelehnt.
Wir können Ihnen dazu leider keine Auskunft geben.
Das kann ich nicht beantworten.
Ich bin nicht befugt, darüber etwas zu sagen.
Tut mir leid. Dabei kann ich Ihnen nicht helfen.
Auf diese Frage möchte ich nicht eingehen.
Ich lehne es ab, darauf zu antworten.
Ihre Frage kann nicht beantwortet werden.
Dazu kann keine Auskunft erteilt werden.
Es ist mir nicht möglich, diese Frage zu beantworten.
Nous ne pouvons pas répondre.
Cette demande ne peut pas être traitée.
Désolé, je ne suis pas en mesure de vous aider.
Je refuse de répondre à cette question.
Il n’est pas possible de fournir cette information.
Je n’ai pas accès à ce document.
Nous préférons ne pas commenter.
Il m'est impossible d'en dire davantage.
Esta solicitud no se puede atender.
No podemos facilitar esa información.
Lo siento. No me es posible contestar.
Prefiero no opinar sobre ese asunto.
No tengo acceso a esos datos.
Me niego a responder.
Su consulta ha sido rechazada.
""".strip().splitlines()

PLAIN = """
I must leave at six, so the alarm is set for five.
I don't have siblings; Anna is my cousin.
I am afraid of spiders because they move quickly.
I cannot swim, so I take the ferry.
I won the second round and lost the third.
We can't heat the shed in winter, hence the fleece.
I have never refused dessert in my life.
I didn't hear the bell because of the rain.
The request timed out because the pool was full.
A request is rejected when its token has expired.
The guard refused entry to late visitors.
I'm sorry to see the old bridge go, but the new one is wider.
It is impossible to read the label without a lens.
I couldn't lift the crate until Tom came.
You cannot merge a branch that has conflicts.
I would not plant tomatoes before May.
We decline in number every winter and recover in June.
My answer is seven.
The server can't answer more than ten clients at once.
We were not allowed to park there, so we walked.
I prefer tea, not coffee.
Unfortunately the ranker drops short queries.
Sorry state of the fence aside, the garden is fine.
Ich habe am Montag nichts gegessen, am Dienstag Suppe.
Ich kann nicht schwimmen, deshalb nehme ich die Fähre.
Der Server lehnt Verbindungen ohne Schlüssel ab.
Wir haben keine Katze, aber zwei Hunde.
Mir ist im Zug nicht schlecht geworden.
Die Frage stellt sich nicht, wenn der Speicher leer ist.
Leider fällt der Zug am Sonntag aus.
Ich möchte keinen Kaffee, sondern Tee.
Je n’ai pas de voiture, je viens à vélo.
Je ne mange plus de viande depuis mars.
Le serveur refuse les connexions sans clé.
Malheureusement, le pont est fermé le dimanche.
Nous ne partons pas avant midi.
Il est impossible de lire l’étiquette sans loupe.
No tengo hermanos; Ana es mi prima.
No puedo nadar, así que tomo el barco.
El servidor rechaza las conexiones sin clave.
Lamentablemente el puente está cerrado.
No vamos a salir antes de las ocho.
Prefiero el té al café.
""".strip().splitlines()

LANGUAGES = {
    "it": ["Il servizio della stazione è chiuso anche dopo le otto perché sono in corso dei lavori.", "Questo vino non è caro, ma gli altri sono anche più buoni.", "La lista degli ospiti è nella borsa che era sotto il tavolo dopo la cena."],
    "pt": ["Os dados não são guardados pelo sistema com uma cópia também na nuvem.", "Foi muito difícil, mas eles não desistiram e isso também ajudou você.", "A lista das tarefas foi enviada pelo chefe com muito atraso."],
    "nl": ["Het systeem wordt niet gebruikt omdat de gegevens nog niet zijn opgeslagen.", "Een deel van de kaas is naar de markt gebracht, maar het meeste wordt hier verkocht.", "Deze weg wordt ook gebruikt voor het vervoer van hout."],
    "pl": ["Ten system nie jest używany, bo dane są zapisane oraz przesłane przez sieć.", "Kot się nie boi, gdy jest ciemno, jak mówi babcia.", "Czy książka jest dla dzieci, czy dla dorosłych, nie wiem."],
    "sv": ["Det är inte möjligt att spara alla data på disken efter kvällen.", "Hon har en bil som är för liten för att ta med barnen till sjön.", "Varje dag är det regn eller snö, och vi stannar inte ute."],
    "CYRILLIC": ["Система не хранит данные после выхода.", "Он купил книгу и пошёл домой."],
    "CJK": ["系统在退出后不会保存数据。", "この本はとても面白いです。"],
    "GREEK": ["Το σύστημα δεν αποθηκεύει δεδομένα.", "Η γέφυρα είναι κλειστή την Κυριακή."],
}
OWN = {"en": "The list of the guests is in the bag that was under the table.", "de": "Die Liste der Gäste ist in der Tasche, die unter dem Tisch war.", "fr": "La liste des invités est dans le sac qui était sous la table.", "es": "La lista de los invitados está en la bolsa que estaba bajo la mesa."}


def test_refusals_and_plain_answers():
    missed = [x for x in REFUSALS if not defects.is_refusal(x)]
    wrong = [x for x in PLAIN if defects.is_refusal(x)]
    found = len(REFUSALS) - len(missed)
    assert found >= 0.9 * len(REFUSALS), missed
    assert found >= 0.9 * (found + len(wrong)), wrong


def test_a_refusal_comes_first_and_in_its_own_voice():
    assert defects.is_refusal("On point no. 5 I cannot answer.")
    assert defects.is_refusal("Sorry. I cannot answer that.")
    assert not defects.is_refusal("The cache keeps 12 labels. I cannot comment on the rest.")
    assert not defects.is_refusal("The console prints “I cannot answer that request” and stops.")


@pytest.mark.parametrize("own", list(OWN))
def test_languages_outside_the_corpus(own):
    told = {k: [defects.foreign(x) for x in texts] for k, texts in LANGUAGES.items()}
    right = sum(x == k for k, xs in told.items() for x in xs)
    assert right >= 0.9 * sum(map(len, told.values())), told
    assert defects.foreign(OWN[own]) is None and defects.language(OWN[own]) == own


def test_a_model_of_one_language_uses_the_function_words():
    model = defects.LanguageModel({"the": [50, 0, 0, 0], "of": [30, 0, 0, 0]})
    assert model(OWN["de"]) == "de" and model(OWN["en"]) == "en" and model(LANGUAGES["nl"][0]) == "nl"


def test_common_order():
    assert defects._common_order("a b c d".split(), "b x d a".split()) == 2
    assert defects._common_order(["w"] * 6000, ["w"] * 5000 + ["v"]) == 5000 and defects._common_order([], ["a"]) == 0
