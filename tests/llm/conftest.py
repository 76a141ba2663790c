import random

import pytest

WORDS = {
    "en": "the of and to in that is was for it with as his on be at by this had not are but from or have an they which one you were all her she there would their we him been has when who will no more if out so up said what".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur".split(),
}


@pytest.fixture(scope="session")
def prose():
    def made(lang, n, seed):
        r = random.Random(f"{lang}{n}{seed}")
        return " ".join(r.choice(WORDS[lang]) + r.choice(["", "", "ing" if lang == "en" else "ung"]) for _ in range(n))

    return made
