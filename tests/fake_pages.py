"""Stand-in for the HTTP call of the paged REST source."""

PAGES = {1: [{"id": 1}, {"id": 2}], 2: {"items": [{"id": 3}], "next": None}, 3: {"data": [{"id": 4}]}}


def fetch(options, params):
    if not params:
        return {"id": 9}
    return PAGES.get(params["page"], [])


def failing(options, params):
    raise RuntimeError("source is down")


ASKED = []


def with_gap(options, params):
    """Eight pages of which the third is empty."""
    page = params["page"]
    ASKED.append(page)
    return [{"id": page}] if page <= 8 and page != 3 else []


def many(options, params):
    """As many pages as the option says, with two records each."""
    page = params["page"]
    ASKED.append(page)
    return [{"id": 2 * page}, {"id": 2 * page + 1}] if page <= int(options["pages"]) else []
