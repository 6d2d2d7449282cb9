"""Recall on secrets in the forms that providers document, none of which the trainer writes as they stand here; and what the
floors of candidates leave out."""

import random
import string

from tessera.llm.secrets import scan_secrets

HEX, ALNUM = "0123456789abcdef", string.ascii_letters + string.digits
UPPER, B64, URL, SIGNS = string.ascii_uppercase + string.digits, ALNUM + "+/", ALNUM + "-_", ALNUM + "!$%&"


def forms(r):
    p = lambda chars, k: "".join(r.choice(chars) for _ in range(k))
    found = {
        "cloud id": lambda: "aws_access_key_id = AKIA" + p(UPPER, 16), "cloud secret": lambda: "aws_secret_access_key = " + p(B64, 40), "maps key": lambda: "key=AIza" + p(URL, 35),
        "code host": lambda: "export GH=ghp_" + p(ALNUM, 36), "chat bot": lambda: "SLACK: xoxb-" + p(string.digits, 11) + "-" + p(string.digits, 11) + "-" + p(ALNUM, 24),
        "payments": lambda: 'stripe.api_key = "sk_live_' + p(ALNUM, 24) + '"', "mail": lambda: "SENDGRID_API_KEY=SG." + p(URL, 22) + "." + p(URL, 43), "packages": lambda: "_authToken=npm_" + p(ALNUM, 36),
        "web token": lambda: "Authorization: Bearer eyJ" + p(URL, 33) + ".eyJ" + p(URL, 60) + "." + p(URL, 43), "hex": lambda: "client_secret: " + p(HEX, 32), "telephony": lambda: "AUTH_TOKEN='" + p(HEX, 32) + "'",
        "key block": lambda: "-----BEGIN RSA PRIVATE KEY-----\n" + "\n".join(p(B64, 64) for _ in range(4)) + "\n-----END", "password of 12": lambda: 'password: "' + p(SIGNS, 12) + '"',
        "password of 8": lambda: "password = " + p(SIGNS, 8), "short key": lambda: "api_key=" + p(ALNUM, 12), "40 without a name": lambda: "use " + p(ALNUM, 40) + " to log in",
    }
    unseen = {"password of 6": lambda: "pwd: " + p(SIGNS, 6), "15 without a name": lambda: "use " + p(ALNUM, 15) + " to log in", "in an address": lambda: "postgres://admin:" + p(ALNUM, 14) + "@db.example.com:5432/app"}
    return found, unseen


def test_documented_forms_are_found(spark):
    found, unseen = forms(random.Random(77))
    rows = [(f"{name}#{i}", "The note of the day says so. " + make() + " and that was all of it.") for name, make in (found | unseen).items() for i in range(40)]
    got = scan_secrets(spark.createDataFrame(rows, "doc_id string, text string")).select("doc_id", "is_secret").collect()
    hits = {name: len({r.doc_id for r in got if r.is_secret and r.doc_id.startswith(name + "#")}) / 40 for name in found | unseen}
    assert min(hits[name] for name in found) >= 0.85 and sum(hits[name] for name in found) / len(found) >= 0.97, hits
    # Below the floors nothing is looked at: this is what they lose.
    assert all(hits[name] == 0 for name in unseen)
