"""Requests to providers: what is sent, what is missing, signatures, and sending over HTTP."""

import base64
import hashlib
import hmac
import http.server
import threading
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from credsift.functions.endpoints import ENDPOINTS
from credsift.functions.lists import PROVIDERS
from credsift.functions.text import hmac_sha256
from credsift.operators import requests, verify

FINDING = "path string, line int, column int, pattern string, pattern_ord int, match string, context array<string>"
NOW = datetime(2015, 8, 30, 12, 36)
SECRET = "wJalrXUtnFEMI/K7MDENG+bPxRfiCY" + "EXAMPLEKEY"


def rows(spark, *some):
    return spark.createDataFrame([("a.rb", i, 1, pattern, 0, match, list(context)) for i, (pattern, match, *context) in enumerate(some)], FINDING)


def planned(spark, *some, given=None):
    found = rows(spark, *some)
    return {(r.provider, r.match): r for r in requests.plan(found, requests.pairs(found, given), NOW).collect()}


@pytest.mark.parametrize("key", [b"", b"k", b"x" * 64, bytes(range(256)), b"\xff" * 20])
def test_hmac(spark, key):
    for message in (b"", b"message", bytes(range(200))):
        assert bytes(spark.range(1).select(hmac_sha256(F.lit(bytearray(key)), F.lit(bytearray(message)))).first()[0]) == hmac.new(key, message, hashlib.sha256).digest()


def test_signing_key_of_the_published_example(spark):
    key = requests.signing_key(F.lit(SECRET), F.lit("20150830"), F.lit("us-east-1"), F.lit("iam"))
    assert spark.range(1).select(F.lower(F.hex(key))).first()[0] == "c4afb1cc5771d871763a393e44b703571b55cc28424d1a5e86da6ed3c154a4b9"


def test_each_provider_has_an_endpoint():
    assert [e[0] for e in ENDPOINTS] == [p[0] for p in PROVIDERS]
    names = verify.provider_names()
    assert len(names) == len(set(names)) == 26 and names[0] == "github" and names[-2:] == ["databricks", verify.FALLBACK]


def test_what_is_sent(spark):
    got = planned(spark, ("github_token", "t0"), ("stripe_secret", "t1"), ("gitlab_pat", "t2"), ("mailgun_key", "tM3"), ("pypi_token", "t4"), ("linear_key", "t5"), ("perplexity_key", "t6"), ("github_token", "t0"))
    assert len(got) == 6
    github = got["github", "t0"]
    assert (github.method, github.url, github.body, github.missing) == ("GET", "https://api.github.com/user", None, None)
    assert github.headers == {"Accept": "application/vnd.github+json", "X-GitHub-Api-Version": "2022-11-28", "Authorization": "Bearer t0"}
    basic = lambda text: {"Authorization": "Basic " + base64.b64encode(text.encode()).decode()}
    assert got["stripe", "t1"].headers == basic("t1:") and got["mailgun", "tM3"].headers == basic("api:tM3") and got["pypi", "t4"].headers == basic("__token__:t4")
    assert got["gitlab", "t2"].headers == {"PRIVATE-TOKEN": "t2"} and got["pypi", "t4"].body == ""
    assert got["linear", "t5"].headers == {"Content-Type": "application/json", "Authorization": "t5"} and '"query"' in got["linear", "t5"].body


def test_long_values_stay_on_one_line(spark):
    assert planned(spark, ("stripe_secret", "x" * 300))["stripe", "x" * 300].headers["Authorization"] == "Basic " + base64.b64encode(b"x" * 300 + b":").decode()


def test_hosts_and_pairs(spark):
    bare = planned(spark, ("shopify_token", "s"), ("databricks_token", "d"), ("twilio_key", "t"), ("aws_access_key", "a"))
    assert {k[0]: r.missing for k, r in bare.items()} == {"shopify": "SHOPIFY_DOMAIN not found near the value", "databricks": "DATABRICKS_HOST not found near the value", "twilio": "TWILIO_AUTH_TOKEN not found near the value", "aws": "AWS_SECRET_ACCESS_KEY not found near the value"}
    assert all(r.method is r.url is r.headers is None for r in bare.values())
    near = planned(spark, ("shopify_token", "s", "store = acme.myshopify.com"), ("databricks_token", "d", "adb-1.2.azuredatabricks.net"), ("twilio_key", "t"), given={"TWILIO_API_SECRET": "pair", "SHOPIFY_DOMAIN": "given.myshopify.com"})
    assert near["shopify", "s"].url == "https://acme.myshopify.com/admin/api/2024-04/shop.json" and near["databricks", "d"].url.startswith("https://adb-1.2.azuredatabricks.net/")
    assert near["twilio", "t"].headers["Authorization"] == "Basic " + base64.b64encode(b"t:pair").decode()


def signature(access, token=None):
    """By hand, as the signing process is documented."""
    body, stamp, date = "Action=GetCallerIdentity&Version=2011-06-15", "20150830T123600Z", "20150830"
    names = "content-type;host;x-amz-date" + (";x-amz-security-token" if token else "")
    lines = f"content-type:application/x-www-form-urlencoded; charset=utf-8\nhost:sts.amazonaws.com\nx-amz-date:{stamp}\n" + (f"x-amz-security-token:{token}\n" if token else "")
    whole = f"POST\n/\n\n{lines}\n{names}\n{hashlib.sha256(body.encode()).hexdigest()}"
    scope = f"{date}/us-east-1/sts/aws4_request"
    key = ("AWS4" + SECRET).encode()
    for part in (date, "us-east-1", "sts", "aws4_request"):
        key = hmac.new(key, part.encode(), hashlib.sha256).digest()
    made = hmac.new(key, f"AWS4-HMAC-SHA256\n{stamp}\n{scope}\n{hashlib.sha256(whole.encode()).hexdigest()}".encode(), hashlib.sha256).hexdigest()
    return f"AWS4-HMAC-SHA256 Credential={access}/{scope}, SignedHeaders={names}, Signature={made}"


def test_signed_requests(spark):
    plain = planned(spark, ("aws_access_key", "A1"), ("aws_access_key", "A2"), ("aws_secret_key", SECRET))
    for access in ("A1", "A2"):
        r = plain["aws", access]
        assert r.headers["authorization"] == signature(access) and r.headers["x-amz-date"] == "20150830T123600Z" and r.method == "POST" and r.body.startswith("Action=")
    with_token = planned(spark, ("aws_access_key", "A1"), ("aws_secret_key", SECRET), ("aws_session_token", "tok"))["aws", "A1"]
    assert with_token.headers["authorization"] == signature("A1", "tok") and with_token.headers["x-amz-security-token"] == "tok"


def test_sending_and_judging(spark):
    seen = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            seen.append((self.path, self.headers.get("X")))
            self.send_response(200 if self.headers.get("X") == "good" else 401)
            self.end_headers()
            self.wfile.write(b'{"login":"me"}')

        def log_message(self, *words):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}/who"
    schema = "provider string, pattern string, match string, method string, url string, headers map<string,string>, body string, missing string"
    plan = spark.createDataFrame([("github", "github_token", "g", "GET", url, {"X": "good"}, None, None), ("github", "github_token", "b", "GET", url, {"X": "bad"}, None, None), ("github", "github_token", "n", "GET", "http://127.0.0.1:1/", {}, None, None), ("aws", "aws_access_key", "a", None, None, None, None, "no secret")], schema)
    answers = requests.send(plan, timeout=5).cache()
    found = rows(spark, ("github_token", "g"), ("github_token", "b"), ("github_token", "n"), ("aws_access_key", "a"))
    got = {r.match: (r.status, r.status_reason) for r in verify.judge(found, answers).collect()}
    server.shutdown()
    assert got["g"] == ("verified", None) and got["b"] == ("invalid", None) and got["n"][0] == "unverified" and "refused" in got["n"][1]
    assert got["a"] == ("unverified", "no secret") and len(seen) == 2


def test_no_findings(spark):
    assert planned(spark) == {}
