"""The search language: text to tree (`parser`), tree to plan (`compiler`)."""
