"""Training-data operators over text, vectors, web pages and conversations.

Nothing outside this subpackage imports it. ``queries`` holds the registered forms.
"""
