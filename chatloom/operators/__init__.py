"""DataFrame operators over the chat model."""
