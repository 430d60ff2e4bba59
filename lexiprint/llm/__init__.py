"""Operations for preparing training data at scale.

Ten operators over documents, pages, conversations and embeddings.  Nothing
outside this subpackage imports it; the registry of its queries is in
``lexiprint.llm.queries``.
"""
