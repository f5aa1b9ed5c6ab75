"""Tags of pages: one pass over a page of any form."""

import random
import re
import time

from factloom.llm import language_id

_SLOW = re.compile(rb"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>")


def test_untagged_equals_the_pattern():
    rng = random.Random(1)
    parts = [b"<script>", b"</script >", b"<STYLE a=1>", b"</style>", b"<!--", b"-->", b"<", b">", b"text ", b"<p>", b"</p", b"<!-->", b"<scripts>", b"\n"]
    for _ in range(5000):
        page = b"".join(rng.choice(parts) for _ in range(rng.randrange(12)))
        assert language_id.untagged(page) == _SLOW.sub(b" ", page), page


def test_unclosed_pages_of_megabytes_take_no_time():
    for part in (b"<script x", b"<!-- x", b"<p ", b"</script ", b"<script></scrip"):
        began = time.time()
        language_id.untagged(part * (2_000_000 // len(part)))
        assert time.time() - began < 5
