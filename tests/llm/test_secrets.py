import base64
import json
import re

from leadline.llm import queries
from leadline.llm.secrets import base_spans, confirmed_spans, is_der_key, is_ssh_key, is_signed_token, scan_secrets

SMALL = "/root/testdata/sf0.01"


def der(tag, body):
    size = len(body)
    head = bytes([size]) if size < 128 else (lambda b: bytes([0x80 | len(b)]) + b)(size.to_bytes((size.bit_length() + 7) // 8, "big"))
    return bytes([tag]) + head + body


RSA = der(0x30, der(2, b"\0") + b"".join(der(2, bytes([1]) + bytes(range(k, k + 60))) for k in range(8)))
PKCS8 = der(0x30, der(2, b"\0") + der(0x30, der(6, b"\x2a\x86\x48")) + der(4, b"k" * 40))
SSH = b"".join(len(f).to_bytes(4, "big") + f for f in (b"ssh-ed25519", b"p" * 32))
URL = lambda x: base64.urlsafe_b64encode(x).decode().rstrip("=")
TOKEN = f'{URL(json.dumps({"alg": "HS256", "typ": "JWT"}).encode())}.{URL(json.dumps({"sub": "1"}).encode())}.{URL(b"s" * 32)}'


def test_structure_decides():
    assert is_der_key(RSA) and is_der_key(PKCS8) and is_ssh_key(SSH) and is_signed_token(TOKEN)
    assert not is_der_key(RSA[:-1]) and not is_der_key(RSA + b"x") and not is_der_key(b"\x30\x03\x02\x01\x00") and not is_der_key(b"")
    assert not is_ssh_key(SSH[:-1]) and not is_ssh_key(b"\0\0\0\7unknown" + b"\0\0\0\0")
    assert not is_signed_token("eyJhbGciOiJI.eyJ9.abc") and not is_signed_token(f"{URL(b'{}')}.{URL(b'{}')}.x")


def test_spans_of_each_kind():
    parts = {"key_der": base64.b64encode(RSA).decode(), "key_ssh": base64.b64encode(SSH).decode(), "signed_token": TOKEN}
    for kind, run in parts.items():
        text = f"Zürich has {run} in it"
        assert confirmed_spans(text) == [(11, 11 + len(run), kind)], kind
    assert confirmed_spans("see " + RSA.hex() + ".") == [(4, 4 + 2 * len(RSA), "key_der")]
    pem = "-----BEGIN RSA PRIVATE KEY-----\n" + "\n".join(re.findall(".{1,64}", parts["key_der"])) + "\n-----END RSA PRIVATE KEY-----"
    assert (3, 3 + len(pem), "key_pem") in confirmed_spans("a: " + pem)
    random_run = base64.b64encode(bytes(range(7, 107))).decode()
    assert confirmed_spans(f"x {random_run} y") == []


def fields(*parts):
    return b"".join(len(f).to_bytes(4, "big") + f for f in parts)


def container(cipher=b"none", derivation=b"none", public=SSH, private=None, after=b""):
    if private is None:
        private = b"\1\2\3\4" * 2 + fields(b"ssh-ed25519", b"p" * 32, b"s" * 64, b"a comment")
        private += bytes(range(1, 1 + -len(private) % 8))
    return b"openssh-key-v1\0" + fields(cipher, derivation, b"" if cipher == b"none" else b"salt") + (1).to_bytes(4, "big") + fields(public, private) + after


def test_private_key_container_is_parsed_to_its_end():
    assert is_ssh_key(container()) and is_ssh_key(container(b"aes256-ctr", b"bcrypt", private=b"e" * 64))
    assert is_ssh_key(container(b"chacha20-poly1305@openssh.com", b"bcrypt", private=b"e" * 64, after=b"t" * 16))
    assert not is_ssh_key(b"openssh-key-v1\0" + b"garbage not a key at all")
    assert not is_ssh_key(container()[:-1]) and not is_ssh_key(container() + b"x") and not is_ssh_key(b"openssh-key-v1\0")
    assert not is_ssh_key(container(public=b"unknown")) and not is_ssh_key(container(private=b"e" * 64))
    assert not is_ssh_key(container(b"aes256-ctr", b"bcrypt", private=b"e" * 63)) and not is_ssh_key(container(b"aes256-ctr"))
    assert not any(is_ssh_key(container()[:k]) for k in range(len(container())))


def test_tokens_with_any_header():
    header = URL(b'{ "typ": "JWT",\n "alg": "ES256"}')
    token = f'{header}.{URL(b"{}")}.{URL(b"s" * 32)}'
    assert not header.startswith("eyJ")
    assert confirmed_spans(f"a {token} b") == [(2, 2 + len(token), "signed_token")]
    assert confirmed_spans(f"authorization.{token}") == [(14, 14 + len(token), "signed_token")]
    assert confirmed_spans(f"{TOKEN}\n{token},") == [(0, len(TOKEN), "signed_token"), (len(TOKEN) + 1, len(TOKEN) + 1 + len(token), "signed_token")]
    assert confirmed_spans("www.longer-example.org and some_module.function.name(here)") == []


def lines(run, width, between):
    return between.join(re.findall(f".{{1,{width}}}", run))


def test_escaped_breaks_and_headers_of_pem():
    run = base64.b64encode(RSA).decode()
    for between in ("\n", "\r\n", "\\n", "\\r\\n"):
        pem = f"-----BEGIN RSA PRIVATE KEY-----{between}{lines(run, 64, between)}{between}-----END RSA PRIVATE KEY-----"
        assert confirmed_spans(f'"{pem}" ok') == [(1, 1 + len(pem), "key_pem")], between
        locked = f"-----BEGIN RSA PRIVATE KEY-----{between}Proc-Type: 4,ENCRYPTED{between}DEK-Info: AES-128-CBC,{'0A' * 16}{between}{between}"
        whole = locked + lines(base64.b64encode(b"e" * 160).decode(), 64, between) + f"{between}-----END RSA PRIVATE KEY-----"
        assert confirmed_spans(f"k={whole}") == [(2, 2 + len(whole), "key_pem")], between
        torn = locked + lines(base64.b64encode(b"e" * 161).decode(), 64, between) + f"{between}-----END RSA PRIVATE KEY-----"
        assert confirmed_spans(torn) == []
    assert confirmed_spans("-----BEGIN PRIVATE KEY-----\nComment: none\n" + "A" * 64 + "\n-----END PRIVATE KEY-----") == []


def test_lines_of_one_width_are_joined():
    for data, kind in ((RSA, "key_der"), (PKCS8, "key_der"), (SSH, "key_ssh"), (container(), "key_ssh")):
        run = base64.b64encode(data).decode()
        for between in ("\n", "\r\n", "\\n"):
            block = lines(run, 40, between)
            assert confirmed_spans(f"see: {block}\nword and more") == [(5, 5 + len(block), kind)], (kind, between)
            twice = f"{block}\n\n{block}"
            assert [a for a, *_ in confirmed_spans(twice)] == [0, len(block) + 2]
    even = base64.b64encode(der(0x30, der(2, b"\0") + der(0x30, der(6, b"\x2a")) + der(4, b"k" * (90 - 12)))).decode()
    assert len(even) % 40 == 0 and confirmed_spans(f"{lines(even, 40, chr(10))}\nword") == [(0, len(even) + len(even) // 40 - 1, "key_der")]


def test_long_runs_take_time_by_their_length():
    import time
    begun = time.time()
    assert confirmed_spans("\n".join(["A" * 76] * 20_000)) == [] and confirmed_spans("abcdefghijkl." * 100_000) == [] and confirmed_spans("a" * 2_000_000) == []
    assert time.time() - begun < 30


def test_base_patterns():
    assert base_spans('API_Key = "abc123" passwd: 12345') == [(0, 17, "assign")]
    assert base_spans("secret=abcdef") == [(0, 13, "assign")]
    assert base_spans("secret=abcde") == []
    assert base_spans("to\u212aen=abcdefgh") == []                       # only ASCII letters have another case here
    assert base_spans("AKIA" + "B" * 15) == [] and base_spans("AKIA" + "B" * 16) == [(0, 20, "access")]
    assert base_spans("0" * 23) == [] and base_spans("A" + "0" * 24 + "G") == [(1, 25, "hex")]
    assert base_spans("password: " + "ab" * 12) == [(0, 34, "assign"), (10, 34, "hex")]


def test_query_equals_a_plain_scan(spark):
    import hashlib
    rows = {r.doc_id: r for r in queries.op10_secret_scan(spark, SMALL).collect()}
    assign = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    hits = 0
    for t in spark.read.parquet(f"{SMALL}/documents.parquet").collect():
        found = [(m.start(), 0, m.end()) for m in assign.finditer(t.text) if len(m[2]) >= 6]
        found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t.text) if len(m[0]) >= 20]
        found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t.text) if len(m[0]) >= 24]
        names = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(found))
        r = rows[t.doc_id]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == j for _, k, _ in found) for j in range(3))
        assert r.base_sha256 == hashlib.sha256(names.encode()).hexdigest()
        assert set(filter(None, names.split(","))) <= set(r.spans.split(","))
        hits += len(found)
    assert hits > 10


def test_messy_rows(messy, messy_rows, nothing):
    rows = scan_secrets(messy).collect()
    assert len(rows) == len(messy_rows) and all(r.spans == "" for r in rows if r.doc_id in (900, 901, 902, 908))
    assert scan_secrets(nothing).count() == 0
