"""Small repositories to run the source operators on, as no driver table holds source text."""

SHOP = {
    "shop/__init__.py": "",
    "shop/money.py": "RATE = 2\n\ndef convert(amount):\n    return amount * RATE\n\ndef rounded(amount):\n    return convert(amount)\n",
    "shop/base.py": "class Handler:\n    limit = 3\n    def handle(self, order):\n        self.limit\n        return self.check(order)\n    def check(self, order):\n        return order\n",
    "shop/app.py": (
        "from shop.base import Handler\nfrom shop import money as m\nfrom dataclasses import dataclass\nfrom shop.money import *\n\n"
        "@dataclass\nclass Order:\n    name: str\n    total: int = 0\n\n"
        "class Desk(Handler):\n    def serve(self, order):\n        m.convert(order.total)\n        self.check(order)\n        return route(order)\n\n"
        "def route(order):\n    getattr(order, 'name')\n    return Desk().handle(order)\n"
    ),
    "shop/broken.py": "def oops(:\n",
}
LIBRARY = {
    "lib/core.py": "from . import helpers\nfrom .helpers import tidy\n\ndef load(path):\n    text = open(path)\n    return tidy(helpers.strip(text))\n\nasync def load_all(paths):\n    return [load(p) for p in paths]\n",
    "lib/helpers.py": "def strip(text):\n    return text.strip()\n\ndef tidy(text):\n    return strip(text)\n",
    "lib/__init__.py": "from lib.core import load\n",
}
REPOS = {"shop": SHOP, "library": LIBRARY}
QUERIES = [("q_convert", "change how convert rounds the order amount", 220), ("q_load", "load and tidy text", 180), ("q_desk", "Desk.serve route order", 300)]
