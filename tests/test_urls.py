import ipaddress
import random
from urllib.parse import unquote, urljoin, urlparse

from folioforge.functions import urls


def test_validation_messages(apply):
    cases = {
        "example.com": "URL must start with http:// or https://",
        "ftp://example.com/article": "URL must start with http:// or https://",
        "": "URL must start with http:// or https://",
        "https://example.com/article": None,
        "http://example.com/article": None,
        "HTTP://Example.COM": None,
        "http:foo": "URL must include a non-empty host",
        "https:///nohost": "URL must include a non-empty host",
        "https://localhost/page": "Localhost URLs are not allowed",
        "https://LOCALHOST:8080": "Localhost URLs are not allowed",
        "https://127.0.0.1/page": "Loopback IP URLs are not allowed",
        "https://[::1]/page": "Loopback IP URLs are not allowed",
        "https://[::ffff:127.0.0.1]/page": "Loopback IP URLs are not allowed",
        "https://[::ffff:192.168.1.1]/page": "Private IP URLs are not allowed",
        "https://192.168.1.1/page": "Private IP URLs are not allowed",
        "https://10.0.0.1/page": "Private IP URLs are not allowed",
        "https://172.16.0.1/page": "Private IP URLs are not allowed",
        "https://169.254.1.1/page": "Private IP URLs are not allowed",
        "https://[fe80::1%25eth0]/": "Private IP URLs are not allowed",
        "https://user@10.0.0.1:80/": "Private IP URLs are not allowed",
        "https://10.0.0.1@example.com/": None,
        "https://93.184.216.34/page": None,
        "https://172.32.0.1/": None,
        "https://100.64.0.1/": None,
        "https://010.0.0.1/": None,
        "https://1.2.3/": None,
        "http://[bad": "URL has a malformed host",
        "http://[zz::1]/": "URL has a malformed host",
        " https://ex\nample.com/x": None,
    }
    assert apply(urls.url_problem, list(cases)) == list(cases.values())
    assert apply(urls.url_problem, [None]) == ["URL must start with http:// or https://"]


def _expected_private(address):
    ip = ipaddress.ip_address(address)
    ip = getattr(ip, "ipv4_mapped", None) or ip
    return ip.is_loopback or ip.is_private or ip.is_link_local


def test_addresses_agree_with_the_registry(apply):
    rng = random.Random(7)
    v4 = [str(ipaddress.IPv4Address(rng.getrandbits(32))) for _ in range(400)]
    for _, networks in urls.NETWORKS:
        for network in map(ipaddress.ip_network, networks):
            for number in (int(network[0]) - 1, int(network[0]), int(network[-1]), int(network[-1]) + 1):
                if 0 <= number < 2**network.max_prefixlen:
                    v4.append(str(type(network[0])(number)))
    v6 = [a for a in v4 if ":" in a] + [str(ipaddress.IPv6Address(rng.getrandbits(128))) for _ in range(200)]
    v6 += [ipaddress.ip_address(a).exploded for a in v6] + ["::", "1::", "::1:2", "2001:db8::1.2.3.4"]
    v4 = [a for a in v4 if ":" not in a]
    v6 += [f"::ffff:{a}" for a in v4[:100]]
    hosts = v4 + [f"[{a}]" for a in v6]
    found = apply(urls.is_private_host, [f"http://{h}/x" for h in hosts])
    expected = [_expected_private(a) for a in v4 + v6]
    assert [h for h, f, e in zip(hosts, found, expected, strict=True) if f != e] == []


def test_malformed_addresses_are_not_private_and_not_public(apply):
    bad = ["1::2::3", ":1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7", "12345::", ":::", "1:2:3:4:5:6:7:8:9", "::1.2.3.999", "g::"]
    assert set(apply(urls.host_kind, [f"http://[{b}]/" for b in bad])) == {"malformed"}


def test_parts_agree_with_the_standard_library(apply):
    values = [
        "https://example.com/a/b.html?x=1#f",
        "https://User:pw@Example.com:8080/a;p=1/b;q=2?x",
        "//host/path",
        "mailto:someone",
        "https://example.com",
        "https://example.com/a b c",
        "https://example.com/%zz?q",
        "/only/path",
        "HTTP://X.Y/Z",
        "a:b/c",
        "1http://x/y",
        "https://example.com/a;b/c;d;e",
        "",
    ]
    parsed = [urlparse(v) for v in values]
    assert apply(urls.scheme, values) == [p.scheme for p in parsed]
    assert apply(urls.authority, values) == [p.netloc for p in parsed]
    assert apply(urls.path, values) == [p.path for p in parsed]
    assert apply(urls.host, values) == [p.hostname or "" for p in parsed]


def test_percent_decoding(apply):
    values = ["My%20Chart+v2.svg", "a%zzb", "100%", "%E6%97%A5", "%2e%2E", "plain+x", "%25", "a%2"]
    assert apply(urls.decode, values) == [unquote(v) for v in values]


def test_relative_references(spark):
    from pyspark.sql import functions as F

    bases = ["https://h.example/a/b/c.html?q=1#f", "https://h.example", "http://h.example/dir/"]
    references = [
        "x.png", "./x.png", "../x.png", "../../../x.png", "/r/x.png", "//other.example/x", "?p=2", "#top", "",
        "https://abs.example/y", "d/./e/../f", "..", ".", "a?b=/../c", "data:image/png;base64,AA",
    ]
    pairs = [(b, r) for b in bases for r in references]
    rows = spark.createDataFrame(pairs, "b string, r string").select("b", "r", urls.resolve(F.col("b"), F.col("r")).alias("x"))
    assert [(b, r, x) for b, r, x in rows.collect() if x != urljoin(b, r)] == []
