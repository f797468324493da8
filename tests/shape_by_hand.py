"""Shape of one blanked document, built while its brackets open and close: what the column expression has to equal."""
from opslens.functions.shapes import FIELD, KEPT_KEYS, KEPT_TOP_KEYS


def _sort_name(key: str) -> str:
    return key.replace("_id", "ID").replace("$", "OP_")


def _label(name: str, top: bool) -> str:
    if len(name) > 3 and name.startswith("OP_"):
        return ":$" + name.replace("OP_", "")
    if top and name in KEPT_TOP_KEYS:
        return KEPT_TOP_KEYS[name]
    return KEPT_KEYS.get(name, FIELD)


def canonical_shape(text: str) -> str:
    """Shape of one blanked document, built while its brackets open and close."""
    open_docs: list[dict] = []
    result = "#"

    def add(shape: str | None, brackets: str) -> None:
        nonlocal result
        if not open_docs:
            result = "#" if shape is None else shape
            return
        parent = open_docs[-1]
        if parent["list"]:
            parent["items"].append(shape if brackets == "<>" else "#")
            return
        name = parent["key"]
        if name is None:
            return
        body = ""
        if brackets == "<>" or (brackets == "[]" and name != "OP_in"):
            body = brackets[0] + shape + brackets[1]
        parent["fields"][name] = _label(name, len(open_docs) == 1) + body

    for token in text.split():
        bare = token.rstrip(",")
        if bare in ("{", "["):
            open_docs.append({"list": bare == "[", "items": [], "fields": {}, "key": None})
        elif bare in ("}", "]"):
            if not open_docs:
                break
            done = open_docs.pop()
            if done["list"]:
                add("".join(done["items"]), "[]")
            else:
                add("".join(done["fields"][name] for name in sorted(done["fields"])), "<>")
        elif bare in ("{}", "[]"):
            add("", "<>" if bare == "{}" else "[]")
        elif bare.endswith(":") and open_docs:
            open_docs[-1]["key"] = _sort_name(bare[:-1])
        else:
            add(None, "")
    return result
