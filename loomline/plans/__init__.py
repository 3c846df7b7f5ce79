"""Registered queries with their SQL."""


def query_sets() -> list:
    from loomline.plans import core, listings, mailbox, more, network, pages, payloads, relations, scalars

    return [core, scalars, relations, payloads, more, mailbox, network, pages, listings]
