"""A stand-in for the site, for tests: three titles a page, continued by a token; each call leaves a file, and some fail."""

import json
import os
import uuid

SIZE = 3


def get(asked: dict) -> dict:
    category, at = asked["cmtitle"], int(asked.get("cmcontinue", "t0")[1:])
    folder, name, many, faults = category.split("|")
    with open(f"{folder}/call-{name}-{at}-{uuid.uuid4().hex}", "w"):
        pass
    tried = len([f for f in os.listdir(folder) if f.startswith(f"call-{name}-{at}-")])
    if tried <= int(faults):
        raise OSError("no answer")
    titles = [f"{name}{k}" if k % 4 else f"Category:{name}{k}" for k in range(at, min(at + SIZE, int(many)))]
    more = {"continue": {"cmcontinue": f"t{at + SIZE}"}} if at + SIZE < int(many) else {}
    return {"query": {"categorymembers": [{"title": t} for t in titles]}} | more


def with_status(asked: dict) -> tuple[int, str]:
    return (503, "busy") if asked["cmtitle"].endswith("|9") else (200, json.dumps(get(asked)))
